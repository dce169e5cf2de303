"""Sources and sinks."""

from tributary.sources.files import CSVExtractor, JSONExtractor
from tributary.sources.jdbc import BoundsLog, JDBCExtractorFullLoad, JDBCExtractorIncremental
from tributary.sources.sinks import HiveLoader, JDBCLoader, ParquetLoader, PartitionDefinition

__all__ = [
    "BoundsLog", "CSVExtractor", "HiveLoader", "JDBCExtractorFullLoad", "JDBCExtractorIncremental", "JDBCLoader", "JSONExtractor",
    "ParquetLoader", "PartitionDefinition",
]
