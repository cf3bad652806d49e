"""DataFrame to DataFrame: the engine's operators, none of them bound to a table."""
