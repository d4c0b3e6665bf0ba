"""The registered queries: their inputs, the queries, and the same results in plain SQL."""
