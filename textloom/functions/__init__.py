"""Column functions: text in, columns out, without Python on the executors."""
