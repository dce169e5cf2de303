"""File sources: JSON lines in text or sequence files, and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.sources.base import Extractor


#: Fixed values that older job definitions carry.
PREFIXES = ("hdfs://nameservice-ha", ":8020")


def remove_hdfs_prefix(path: str, prefixes: tuple[str, ...] = PREFIXES) -> str:
    """``path`` without the name service and port that older job definitions carry."""
    for prefix in prefixes:
        path = path.replace(prefix, "")
    return path


def fix_suffix(path: str) -> str:
    """``path`` ending in ``/*``."""
    return path if path.endswith("/*") else f"{path.rstrip('/')}/*"


def infer_input_path_from_partition(base_path: str, partition: str | int) -> str:
    """``<base>/yy/mm/dd/*`` of a partition ``yyyymmdd``."""
    day = str(partition)
    return "/".join([remove_hdfs_prefix(base_path), day[2:4], day[4:6], day[6:8], "*"])


def _one_line(value: Column, kind: T.DataType) -> Column:
    """Line breaks inside all texts of a value: ``\\n`` to a blank, ``\\r`` dropped."""
    if isinstance(kind, T.StringType):
        return F.translate(value, "\n\r", " ")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _one_line(x, kind.elementType)) if _has_text(kind) else value
    if isinstance(kind, T.StructType) and _has_text(kind):
        fields = [_one_line(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    return any(_has_text(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else isinstance(kind, T.StringType)


class JSONExtractor(Extractor):
    """One JSON object per line, in text files or in the values of sequence files.

    ``input_path`` wins over ``base_path`` with ``partition`` (``yyyymmdd``). Which kind of file it is shows in
    the first file's head. Lines that are no JSON go to ``_corrupt_record``. With a ``schema`` no inference
    job runs; ``sampling_ratio`` shortens inference. Line breaks inside texts become blanks after parsing,
    unless ``keep_line_breaks``.
    """

    def __init__(self, input_path: str | None = None, base_path: str | None = None, partition: str | int | None = None, schema=None, sampling_ratio: float | None = None, keep_line_breaks: bool = False):
        self.input_path = self._path(input_path, base_path, partition)
        self.base_path, self.partition = base_path, partition
        self.schema, self.sampling_ratio, self.keep_line_breaks = schema, sampling_ratio, keep_line_breaks

    @staticmethod
    def _path(input_path, base_path, partition) -> str:
        if input_path:
            return fix_suffix(remove_hdfs_prefix(input_path))
        if base_path and partition:
            return infer_input_path_from_partition(base_path, partition)
        raise AttributeError("Please define either (input_path) or (base_path and partition)")

    def _is_sequence_file(self, spark: SparkSession) -> bool:
        jvm = spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(self.input_path.split(",")[0])
        fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(pattern) or []:
            if status.isFile() and status.getLen() > 3 and not status.getPath().getName().startswith(("_", ".")):
                stream = fs.open(status.getPath())
                try:
                    return bytes([stream.read() & 255 for _ in range(3)]) == b"SEQ"
                finally:
                    stream.close()
        return False

    def extract(self) -> DataFrame:
        spark = SparkSession.active()
        reader = spark.read.option("mode", "PERMISSIVE")
        if self.schema is not None:
            reader = reader.schema(self.schema)
        if self.sampling_ratio:
            reader = reader.option("samplingRatio", self.sampling_ratio)
        if self._is_sequence_file(spark):
            # the one format without a DataFrame reader; turning its values into texts inside the JVM would need classes of one's own there
            values = spark.sparkContext.sequenceFile(self.input_path).map(lambda kv: bytes(kv[1]).decode("utf-8") if not isinstance(kv[1], str) else kv[1])
            df = reader.json(values)
        else:
            df = reader.json(self.input_path.split(","))
        if self.keep_line_breaks:
            return df
        return df.select(*[_one_line(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


class CSVExtractor(Extractor):
    """Separated text with a header. Give a ``schema`` to spare the inference job."""

    def __init__(self, input_path: str, sep: str = ";", header: bool = True, schema=None):
        self.input_path, self.sep, self.header, self.schema = input_path, sep, header, schema

    def extract(self) -> DataFrame:
        reader = SparkSession.active().read.option("sep", self.sep).option("header", self.header)
        reader = reader.schema(self.schema) if self.schema is not None else reader.option("inferSchema", True)
        return reader.csv(self.input_path)
