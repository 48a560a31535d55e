"""trellisq: timetable analytics, data quality and graph search on PySpark."""

__version__ = "0.1.0"
