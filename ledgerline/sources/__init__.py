"""Where models and tables come from, and where results go."""
