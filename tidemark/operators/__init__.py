"""Point-in-time, calendar, universe, adjustment and return operators: DataFrame to DataFrame."""
