"""filamet: fiber-diameter metrology as Spark DataFrame operators."""
