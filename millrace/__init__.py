"""millrace: DataFrame operators for mining event histories, document collections and tables."""
