"""What the operators of this subpackage share: the shared work folder, word splitting, ordered neighbours."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The character classes of the three kinds of words.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
LETTER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_LETTERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Folders that this driver has named, and the one that it has made where none is set.
_made: list[str] = []
_own: list[str] = []

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset (local runs) a temporary folder of this driver stands in for it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-work-"))
        base = _own[0]
    return base


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all machines share."""
    path = f"{_base(spark).rstrip('/')}/tomeloom-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def table_name(path: str) -> str:
    """Name of the table that lies in a work folder."""
    return "tomeloom_" + path.rpartition("-")[2]


def clear_work(spark: SparkSession) -> int:
    """Delete what this driver's operators have written below the shared folder, and its tables; the number of folders.

    For use when the results are stored elsewhere: DataFrames that the operators returned read these folders.
    """
    gone = 0
    while _made:
        name = _made.pop()
        spark.sql(f"DROP TABLE IF EXISTS {table_name(name)}")
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() is quicker and the same where a text has no other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lowered(text: str) -> str:
    """As ascii_lower() in a task: bytes lower-case A-Z only."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def letter_words(text: Column) -> Column:
    """Array of the lower-cased words of LETTER_WORD; null and empty texts have none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_LETTERS), lambda w: w != "")


def count_space_words(text: Column) -> Column:
    """Number of words of SPACE_WORD as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def shingle_hashes(words: Column, size: int = 5) -> Column:
    """64-bit hashes of the runs of `size` words; a text of fewer words, but not none, is one shingle."""
    n = F.size(words)
    runs = F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, size))))
    return runs.when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
