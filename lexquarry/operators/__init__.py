"""Table-valued operators: line search, gram scan, index, byte statistics, quotas."""
