"""Graph operators over DataFrames: rules, algorithms, search, writes, history, visibility."""
