"""Code-quality and corpus analytics as Spark DataFrame operators."""
