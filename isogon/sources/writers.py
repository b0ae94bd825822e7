"""Writers of survey text, of model coefficients and of a catalogue in a database."""

from __future__ import annotations

import io
import os
import re
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isogon.functions.mainfield import Model


def fixed(df: DataFrame, path: str, *cols: str, digits: dict[str, int] | int = 6, sep: str = ",", mode: str = "errorifexists", extra: str | None = None, order: list[str] | None = None) -> None:
    """Lines of fixed decimals, rows with a null, NaN or infinite value left out; with
    order, files and the lines in them are in its order."""
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")))
    d = digits if isinstance(digits, dict) else dict.fromkeys(cols, digits)
    text = [F.regexp_replace(F.format_number(F.col(c).cast("double"), d[c]), ",", "") for c in cols]
    if extra is not None:
        text.append(F.lit(extra))
    if order:
        df = df.orderBy(*order)
    df.select(F.concat_ws(sep, *text).alias("value")).write.mode(mode).text(path)


def export_complexity(df: DataFrame, path: str) -> None:
    """lon, lat, base value and the flag of a spacing of 8 or more; each file begins with a
    byte order mark and a header."""
    head = "\ufefflon"
    df.select(F.col("lon").alias(head), "lat", F.col("base").alias("baseMag"), F.when(F.col("spacing") >= 8, 1).otherwise(0).alias("index")).write.csv(path, header=True)


def table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Query results, comma-separated with a header, lines ended by CR and LF."""
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    head = df.sparkSession.createDataFrame([(",".join(df.columns),)], "value string").coalesce(1)
    rows = head.withColumn("_o", F.lit(0)).unionAll(df.select(text.alias("value"), F.lit(1).alias("_o")))
    rows.select("value").write.mode(mode).option("lineSep", "\r\n").text(path)


def append_catalogue(df: DataFrame, path: str) -> None:
    """Blank-separated lines at the end of a catalogue."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode("append").text(path)


def parameters(df_spark, path: str, **values: float) -> None:
    """A one-row table of parameters."""
    df_spark.createDataFrame([values]).coalesce(1).write.mode("overwrite").json(path)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, whole, through Hadoop's file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(data)
    finally:
        out.close()


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A file or folder copied into a project."""
    sc = spark.sparkContext
    a, b, conf = sc._jvm.org.apache.hadoop.fs.Path(source), sc._jvm.org.apache.hadoop.fs.Path(target), sc._jsc.hadoopConfiguration()
    if not sc._jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf):
        raise OSError(f"{source} was not copied")


def listing(spark: SparkSession, path: str, *endings: str) -> list[str]:
    """The names of a project's files with these endings, sorted."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(p)
    names = [f.getPath().getName() for f in found]
    return sorted(n for n in names if not endings or n.endswith(endings))


def execute(spark: SparkSession, url: str, *statements: str) -> None:
    """Statements through the driver's JDBC, each by itself."""
    link = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        for text in statements:
            ask = link.createStatement()
            ask.execute(text)
            ask.close()
    finally:
        link.close()


def sealed(spark: SparkSession, folder: str, path: str) -> str:
    """A small Derby database in a folder of the driver's, closed and packed for reading only
    into a file at path, in a file system that all executors mount. Returns its URL: unlike
    a folder or a database in memory, any number of processes can open it."""
    at = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
    if not at:
        raise ValueError(f"{path} is not in a mounted file system")
    try:
        spark.sparkContext._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{folder};shutdown=true").close()
    except Py4JJavaError as e:  # Derby reports the end as an exception
        if e.java_exception.getSQLState() != "08006":
            raise
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for top, _, names in os.walk(folder):
            for name in sorted(names):
                if not name.endswith(".lck"):
                    z.write(os.path.join(top, name), os.path.join("db", os.path.relpath(os.path.join(top, name), folder)))
    put(spark, path, data.getvalue())
    return f"jdbc:derby:jar:({at[1]})db"


class Catalogue:
    """Changes to a catalogue table in a database: they wait until submit(), which makes
    all of them in one transaction or none; cancel() forgets them. Values are parameters
    of prepared statements."""

    def __init__(self, spark: SparkSession, url: str, table: str, key: str = "name"):
        self.spark, self.url, self.table, self.key, self.waiting = spark, url, table, key, []

    def add(self, **row) -> None:
        self.waiting.append(("INSERT", None, row))

    def update(self, key, **row) -> None:
        self.waiting.append(("UPDATE", key, row))

    def delete(self, key) -> None:
        self.waiting.append(("DELETE", key, {}))

    def _statement(self, kind: str, key, row: dict, q: str) -> tuple[str, list]:
        names, where = [f"{q}{c}{q}" for c in row], f"WHERE {q}{self.key}{q} = ?"
        if kind == "INSERT":
            return f"INSERT INTO {self.table} ({', '.join(names)}) VALUES ({', '.join('?' * len(row))})", [*row.values()]
        if kind == "UPDATE":
            return f"UPDATE {self.table} SET {', '.join(f'{c} = ?' for c in names)} {where}", [*row.values(), key]
        return f"DELETE FROM {self.table} {where}", [key]

    def cancel(self) -> None:
        self.waiting = []

    def submit(self) -> None:
        link = self.spark.sparkContext._jvm.java.sql.DriverManager.getConnection(self.url)
        try:
            link.setAutoCommit(False)
            try:
                q = link.getMetaData().getIdentifierQuoteString().strip()
                for change in self.waiting:
                    text, values = self._statement(*change, q)
                    ask = link.prepareStatement(text)
                    for i, v in enumerate(values, 1):
                        ask.setObject(i, v)
                    ask.executeUpdate()
                    ask.close()
                link.commit()
            except Exception:
                link.rollback()
                raise
        finally:
            link.close()
        self.waiting = []


def cof_lines(model: Model, name: str, date: str) -> list[str]:
    """A model with its yearly changes: header, then n m g h gdot hdot, then nines."""
    out = [f"    {model.epoch:.1f}               {name}              {date}"]
    for n, m in _terms(model.top):
        out.append(f" {n:2d} {m:2d} {model.g[n, m]:9.4f} {model.h[n, m] if m else 0.0:9.4f}  {model.gdot[n, m]:9.4f} {model.hdot[n, m] if m else 0.0:9.4f}")
    return [*out, "9" * 48]


def pair_lines(model: Model, name: str, date: str) -> tuple[list[str], list[str]]:
    """A model as two files: the field with a header, and its yearly changes."""
    field, change = [f"    {model.epoch:.1f}               {name}              {date}"], []
    for n, m in _terms(model.top):
        field.append(f" {n:2d} {m:2d} {model.g[n, m]:9.4f} {model.h[n, m] if m else 0.0:9.4f}")
        change.append(f" {n:2d} {m:2d} {model.gdot[n, m]:9.4f} {model.hdot[n, m] if m else 0.0:9.4f}")
    return field, change


#: fixed value: the line a model begins with in a file of several epochs
SHDF_HEAD = "%SHDF 16695 Definitive Geomagnetic Reference Field Model Coefficient File"


def shdf_lines(models: list[Model], name: str) -> list[str]:
    """Models of several epochs in one file: % keys, # notes, then I,n,m,g,h,gdot,hdot. A
    model ends where the next begins, the last after as long as the one before it."""
    out = []
    for i, m in enumerate(models):
        span = models[i + 1].epoch - m.epoch if i + 1 < len(models) else m.epoch - models[i - 1].epoch if i else 5
        keys = {"ModelName": name, "ModelStartYear": int(m.epoch), "ModelEndYear": int(m.epoch) + int(span), "Epoch": f"{m.epoch:.0f}", "IntStaticDeg": m.top, "IntSecVarDeg": m.top, "ExtStaticDeg": 0, "ExtSecVarDeg": 0}
        out += [SHDF_HEAD, *(f"%{k}: {v}" for k, v in keys.items()), "# I/E, n, m, Gnm, Hnm, SV-Gnm, SV-Hnm"]
        for n, k in _terms(m.top):
            h, hd = (f"{m.h[n, k]:f}", f"{m.hdot[n, k]:f}") if k else ("", "")
            out.append(f"I,{n},{k},{m.g[n, k]:f},{h},{m.gdot[n, k]:f},{hd}")
    return out


def _terms(top: int) -> list[tuple[int, int]]:
    return [(n, m) for n in range(1, top + 1) for m in range(n + 1)]
