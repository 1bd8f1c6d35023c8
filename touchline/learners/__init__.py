"""Tree learners whose work Spark deals out: byte codes, growing, fitting, search."""
