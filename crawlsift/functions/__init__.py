"""Spark SQL expression builders: text, URL, markup, JSON, CSV, Markdown and money.

Each takes column names or SQL expressions as text and returns a SQL expression as text, for `F.expr` and
`selectExpr`. Text is one call to the JVM however large the expression is, and reads like the SQL it is.
"""
