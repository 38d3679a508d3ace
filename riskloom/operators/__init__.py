"""DataFrame to DataFrame operators: cleaning, metrics, drift, fairness, alerts."""
