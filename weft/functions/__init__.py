"""Column functions, all of them inside Spark's own expressions unless a module says otherwise."""
