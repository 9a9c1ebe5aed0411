"""A PySpark-native engine for institution and applicant tables and for a crawled corpus about them."""
