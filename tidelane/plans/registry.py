"""All queries of the library but those of the training-data operators, and their SQL."""

from . import dimension_queries, file_queries, io_queries, series_queries, text_queries, yearbook_queries

QUERIES = {**series_queries.Q, **dimension_queries.Q, **text_queries.Q, **io_queries.Q, **yearbook_queries.Q, **file_queries.Q}
SQL = {**series_queries.SQL, **dimension_queries.SQL, **text_queries.SQL, **io_queries.SQL, **yearbook_queries.SQL, **file_queries.SQL}
