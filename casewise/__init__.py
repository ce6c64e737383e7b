"""Case selection and evaluation as PySpark DataFrame operators."""
