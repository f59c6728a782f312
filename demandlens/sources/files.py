"""Reading trip files and the zone lookup, and writing results."""

from __future__ import annotations

import shutil
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..schemas import LOOKUP_COLUMNS, RAW_COLUMNS

# Places of the public trip records.
TRIP_URL = "https://d37ci6vzurychx.cloudfront.net/trip-data/{kind}_tripdata_{year:04d}-{month:02d}.parquet"
LOOKUP_URL = "https://d37ci6vzurychx.cloudfront.net/misc/taxi_zone_lookup.csv"


def trip_url(year: int, month: int, kind: str = "yellow") -> str:
    if not 1 <= month <= 12:
        raise ValueError(f"month must be 1 to 12, not {month}")
    return TRIP_URL.format(kind=kind, year=year, month=month)


def download(url: str, to: str | Path, overwrite: bool = False) -> Path:
    """Fetch a file on the driver unless it is there already."""
    to = Path(to)
    if to.exists() and not overwrite:
        return to
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(to.name + ".part")
    with urllib.request.urlopen(url, timeout=120) as got, part.open("wb") as out:
        shutil.copyfileobj(got, out, 1 << 20)
    return part.replace(to)


def download_months(months: list[tuple[int, int]], folder: str | Path, overwrite: bool = False, kind: str = "yellow") -> list[Path]:
    urls = [trip_url(y, m, kind) for y, m in months]
    return [download(u, Path(folder) / u.rpartition("/")[2], overwrite) for u in urls]


def download_lookup(folder: str | Path, overwrite: bool = False) -> Path:
    return download(LOOKUP_URL, Path(folder) / LOOKUP_URL.rpartition("/")[2], overwrite)


def load_trips(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """Trip records with the wanted columns that exist (all columns if none does), under their stored names; columns may have those already.

    A path that is missing raises FileNotFoundError.
    """
    try:
        raw = spark.read.parquet(*paths)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(", ".join(paths)) from None
        raise
    have = [c for c in columns or dict.fromkeys([*RAW_COLUMNS, *RAW_COLUMNS.values()]) if c in raw.columns] or raw.columns
    return raw.select(*(F.col(c).alias(RAW_COLUMNS.get(c, c)) for c in have))


def load_zones(spark: SparkSession, path: str) -> DataFrame:
    """The zone lookup from CSV; without its four columns ValueError.  Missing names stay null; other columns are kept."""
    raw = spark.read.option("header", True).csv(path)
    if missing := [c for c in LOOKUP_COLUMNS if c not in raw.columns]:
        raise ValueError(f"the lookup lacks {', '.join(missing)}")
    rest = [c for c in raw.columns if c not in LOOKUP_COLUMNS]
    return raw.select(*(F.col(c).try_cast("long").alias(n) if n == "location_id" else F.col(c).alias(n) for c, n in LOOKUP_COLUMNS.items()), *rest)


def write_csv(df: DataFrame, path: str) -> str:
    """One CSV file with a header at path, in place of what was there, for results small enough to report."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts, place = jvm.org.apache.hadoop.fs.Path(f"{path}.parts"), jvm.org.apache.hadoop.fs.Path(path)
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(parts.toString())
    store = parts.getFileSystem(conf)
    made = store.globStatus(jvm.org.apache.hadoop.fs.Path(parts, "part-*.csv"))
    store.delete(place, True)
    if len(made):
        store.rename(made[0].getPath(), place)
    else:  # Spark writes no file for a result without partitions
        store.create(place).close()
    store.delete(parts, True)
    return path


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A report that write_csv made; its types are inferred, as it is small."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
