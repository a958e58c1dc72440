"""Training-data pipeline operators (documents, pages, benchmark, labels).

Nothing else in the library imports this subpackage."""
