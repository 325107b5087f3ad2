"""What the operators need of a session."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed; once a session."""
    context = spark.sparkContext
    if getattr(context, "_lodestack_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    to = pathlib.Path(tempfile.mkdtemp(prefix="lodestack-code-")) / "lodestack.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(to))
    context._lodestack_shipped = True


def session(name: str = "lodestack", **conf: str) -> SparkSession:
    """A session with the settings that the engine is made for; ``conf`` adds to them."""
    made = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    made = made.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        made = made.config(key, value)
    spark = made.getOrCreate()
    ship(spark)
    return spark
