"""DataFrame operators: each takes DataFrames plus column parameters and returns a lazy DataFrame."""
