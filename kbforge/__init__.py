"""kbforge: DataFrame operators for document knowledge bases and project analytics."""
