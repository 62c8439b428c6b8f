"""Document text analytics on PySpark: text model, search, keywords, screening and admission."""
