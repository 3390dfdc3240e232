"""flowlens: program-structure and trace analytics as Spark DataFrame operators."""
