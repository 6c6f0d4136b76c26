"""DataFrame operators: views and joins (B, C), reports (D), bulk change jobs (I), quality checks (J)."""
