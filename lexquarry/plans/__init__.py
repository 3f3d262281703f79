"""The domain optimizer: regex parsing, translation, index plans and their compilation to columns."""
