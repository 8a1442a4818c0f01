"""From text to plans: the expression language and declarative pipelines."""
