"""Readers of survey text files. A line is parsed by column expressions; what can't be
parsed is told apart by a status, not by an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isogon.functions import geo

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value): line numbers from 0 in file order within each file. Files are
    read in splits; a line's number is its place in its split, and the lines of the splits
    before it, whose counts are one row a split."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), "value")
    splits = raw.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return raw.join(splits, ["file", "_start"]).select("file", (F.col("_base") + F.col("_at") - F.col("_first")).alias("line_no"), "value")


def xyz(spark: SparkSession, path: str | list[str], salvage: bool = True) -> DataFrame:
    """Lenient points (file, id, x, y, v): blank lines are passed over, quotes dropped,
    commas and tabs are blanks; with salvage any first three numbers of a line count."""
    df = lines(spark, path).where(F.trim("value") != "")
    clean = F.trim(F.regexp_replace(F.regexp_replace("value", "[\"']", ""), r"[,;\t]+", " "))
    found = F.regexp_extract_all(clean, F.lit(f"({NUMBER})"), 1) if salvage else F.split(clean, r"\s+")
    df = df.withColumn("f", found)
    cols = [F.get("f", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("x", "y", "v"))]
    return df.select("file", F.col("line_no").alias("id"), *cols).where("x is not null and y is not null and v is not null")


def sniff(spark: SparkSession, path: str, rows: int = 10) -> str:
    """The separator that most of the first lines agree on with three fields or more."""
    head = [r.value for r in spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").limit(rows).collect()]
    best, score = ",", -1
    for sep in (",", "\t", ";", " "):
        counts = [len(h.split(sep) if sep != " " else h.split()) for h in head]
        good = [c for c in counts if c >= 3]
        s = max((good.count(c) for c in set(good)), default=0)
        if s > score:
            best, score = sep, s
    return best


def classed(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, v, index) by the sniffed separator; # starts a comment; three or four
    fields, the fourth a class."""
    sep = sniff(spark, path)
    df = lines(spark, path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    f = df.withColumn("f", F.split(F.trim("value"), r"\s+" if sep == " " else f"\\s*{sep}\\s*")).where(F.size("f").isin(3, 4))
    cols = [F.get("f", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("x", "y", "v"))]
    return f.select(F.col("line_no").alias("id"), *cols, F.get("f", F.lit(3)).try_cast("int").alias("index")).where("x is not null and y is not null and v is not null")


def base_map(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, x, y, v, status): status ok, blank, arity or number."""
    df = lines(spark, path).withColumn("f", F.split(F.trim("value"), r"[\s,;]+"))
    cols = [F.get("f", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("x", "y", "v"))]
    status = F.when(F.trim("value") == "", "blank").when(F.size("f") != 3, "arity").when(F.get("f", F.lit(0)).try_cast("double").isNull() | F.get("f", F.lit(1)).try_cast("double").isNull() | F.get("f", F.lit(2)).try_cast("double").isNull(), "number").otherwise("ok")
    return df.select("line_no", *cols, status.alias("status"))


def strict_triples(spark: SparkSession, path: str) -> DataFrame:
    """Exactly three numbers a line, else the line is passed over."""
    return base_map(spark, path).where("status = 'ok'").drop("status")


def fusion_source(spark: SparkSession, path: str, error: float, source: int) -> DataFrame:
    """Strict l b t, one blank between; a bad row fails the read."""
    df = spark.read.csv(path, sep=" ", schema="l double, b double, t double", mode="FAILFAST")
    return df.withColumns({"m": F.lit(float(error)), "source_id": F.lit(source)})


def track(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, seq, x, y, v): comma-separated, three fields or more; row order is time;
    a track is a file."""
    df = lines(spark, path).withColumn("f", F.split("value", ",")).where(F.size("f") >= 3)
    cols = [F.get("f", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("x", "y", "v"))]
    return df.select(F.col("file").alias("track_id"), F.col("line_no").alias("seq"), *cols).where("x is not null and y is not null and v is not null")


def places(spark: SparkSession, path: str) -> DataFrame:
    """(seq, x, y): two numbers; # and // start comments."""
    df = lines(spark, path).where("trim(value) <> '' and not startswith(trim(value), '#') and not startswith(trim(value), '//')")
    f = df.withColumn("f", F.split(F.trim("value"), r"[,\s;]+"))
    return f.select(F.col("line_no").alias("seq"), F.get("f", F.lit(0)).try_cast("double").alias("x"), F.get("f", F.lit(1)).try_cast("double").alias("y")).where("x is not null and y is not null")


SURVEY = ["name", "date", "time", "tm", "g", "depth", "lon", "lat", "speed", "heading", "t1", "v", "t2", "adjust", "t3"]


def _ordinals(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, doc_id): the files' places in paths, by the name that a read gives them."""
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    named = [(path(p).getFileSystem(conf).makeQualified(path(p)).toUri().toString(), i) for i, p in enumerate(paths)]
    return spark.createDataFrame(named, "file string, doc_id int").select(_plain(F.col("file")).alias("file"), "doc_id")


def _plain(file: Column) -> Column:
    return F.regexp_replace(file, "^([A-Za-z0-9]+):/+", "$1:/")


def survey_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Fifteen-column survey lines of many files; bad lines are passed over. doc_id is the
    file's place in paths; gps_week and gps_seconds are the time's (whole seconds), x and y
    the projected place, z is 0, height minus the depth."""
    df = lines(spark, paths).withColumn("f", F.split("value", ",")).where(F.size("f") >= 15)
    cols = [F.trim(F.col("f")[i]).alias(c) if i < 3 else F.trim(F.col("f")[i]).try_cast("double").alias(c) for i, c in enumerate(SURVEY)]
    out = df.select("file", F.col("line_no").alias("id"), *cols)
    for i, c in enumerate(("year", "month", "day")):
        out = out.withColumn(c, F.get(F.split("date", r"\D+"), F.lit(i)).try_cast("int"))
    for i, c in enumerate(("hour", "minute")):
        out = out.withColumn(c, F.get(F.split("time", r"[^\d.]+"), F.lit(i)).try_cast("int"))
    out = out.withColumn("second", F.get(F.split("time", r"[^\d.]+"), F.lit(2)).try_cast("double"))
    for c in ("year", "month", "day", "hour", "minute", "second", *SURVEY[3:]):
        out = out.where(F.col(c).isNotNull())
    out = out.withColumn("_jd", geo.julian_date(*(F.col(c) for c in ("year", "month", "day", "hour", "minute", "second"))))
    out = out.withColumns({"gps_week": geo.gps_week(F.col("_jd")), "gps_seconds": geo.gps_seconds(F.col("_jd")), "_xy": geo.gauss_kruger(F.col("lat"), F.col("lon")), "height": -F.col("depth")})
    out = out.withColumns({"x": F.col("_xy.x"), "y": F.col("_xy.y"), "z": F.lit(0.0)}).drop("_jd", "_xy")
    files = _ordinals(spark, paths).withColumnRenamed("file", "_f")  # a row for each path given
    return out.withColumn("_f", _plain(F.col("file"))).join(F.broadcast(files), "_f", "left").drop("_f")


def model_queries(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, year, reference, height_km, lat, lon, read, ok): five fields, the height with its
    unit in front: K as it is, M times 1000, F by 3280.0839895. read: whether the line has this
    form; ok: whether its height, latitude and longitude are in range too."""
    df = lines(spark, path).where("trim(value) <> ''").withColumn("f", F.split(F.trim("value"), " +"))
    unit, h = F.substring(F.get("f", F.lit(2)), 1, 1), F.substring(F.get("f", F.lit(2)), 2, 40).try_cast("double")
    height = F.when(unit == "K", h).when(unit == "M", h * 1000).when(unit == "F", h / 3280.0839895)
    at = lambda i: F.get("f", F.lit(i)).try_cast("double")
    read = F.coalesce((F.size("f") == 5) & at(0).isNotNull() & F.get("f", F.lit(1)).isin("E", "M") & height.isNotNull() & at(3).isNotNull() & at(4).isNotNull(), F.lit(False))
    ok = read & height.between(-9999.9999, 9999.9999) & at(3).between(-90, 90) & at(4).between(-180, 180)
    return df.select("line_no", at(0).alias("year"), F.get("f", F.lit(1)).alias("reference"), height.alias("height_km"), at(3).alias("lat"), at(4).alias("lon"), read.alias("read"), F.coalesce(ok, F.lit(False)).alias("ok"))


def complexity_file(spark: SparkSession, path: str, synonyms: dict[str, str]) -> DataFrame:
    """Columns by a header's names (through synonyms) or by place; a byte order mark is
    passed over; six fields or more."""
    names = ["lon_grid", "lat_grid", "lon", "lat", "value", "spacing", "base"]
    head = spark.read.text(path).first()
    cells = [c.strip().lower() for c in (head.value.lstrip("﻿") if head else "").split(",")]
    known = {synonyms.get(c, c): i for i, c in enumerate(cells)}
    at = {n: known.get(n, i) for i, n in enumerate(names)} if any(n in known for n in names) else {n: i for i, n in enumerate(names)}
    df = lines(spark, path).withColumn("f", F.split(F.regexp_replace("value", "^\ufeff", ""), ",")).where(F.size("f") >= 6)
    return df.select(F.col("line_no").alias("id"), *[F.trim(F.get("f", F.lit(at[n]))).try_cast("double").alias(n) for n in names]).where("lon is not null and lat is not null and spacing is not null")


def extents(spark: SparkSession, path: str | list[str], salvage: bool = False) -> DataFrame:
    """(file, x_min, x_max, y_min, y_max, n) of the lines of exactly three numbers between
    blanks, commas or semicolons; with salvage of three or more between blanks."""
    df = lines(spark, path).withColumn("f", F.split(F.trim("value"), r"\s+" if salvage else r"[\s,;]+"))
    at = [F.get("f", F.lit(i)).try_cast("double") for i in range(3)]
    ok = (F.size("f") >= 3 if salvage else F.size("f") == 3) & at[0].isNotNull() & at[1].isNotNull() & at[2].isNotNull()
    rows = df.where(ok).select("file", at[0].alias("x"), at[1].alias("y"))
    return rows.groupBy("file").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count("*").alias("n"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, row array<double>): a bare matrix, numbers between blanks or commas; what
    is no number is null."""
    df = lines(spark, path).where("trim(value) <> ''")
    return df.select("line_no", F.transform(F.split(F.trim("value"), r"[\s,;]+"), lambda x: x.try_cast("double")).alias("row"))


#: fixed values: degrees added to the places of stored maps
STORED_LON, STORED_LAT = 110.0, 17.0


def stored_maps(spark: SparkSession, paths: dict[float, str]) -> DataFrame:
    """(height, lon, lat, v) of maps stored by height, a file or folder each."""
    out = None
    for height, path in paths.items():
        m = strict_triples(spark, path).select(F.lit(float(height)).alias("height"), (F.col("x") + STORED_LON).alias("lon"), (F.col("y") + STORED_LAT).alias("lat"), "v")
        out = m if out is None else out.unionByName(m)
    return out


def raster_image(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, v): pixels as grey / 255, decoded by Spark's image source; of
    colours the grey is (11 red + 16 green + 5 blue) / 32, whole."""
    im = spark.read.format("image").load(path).select("image.*")
    at = lambda c: F.conv(F.hex(F.substring("data", F.lit(1) + (F.col("row") * F.col("width") + F.col("col")) * F.col("nChannels") + c, F.lit(1))), 16, 10).cast("int")
    px = im.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    grey = F.when(F.col("nChannels") == 1, at(0)).otherwise(F.floor((at(2) * 11 + at(1) * 16 + at(0) * 5) / 32))
    return px.select(F.col("origin").alias("file"), "row", "col", (grey / 255.0).alias("v"))


#: fixed values: degrees between the places of a raster of points, and what stands for none
RASTER_STEP, RASTER_NONE = 2.0 / 60.0, -99999.9999


def raster_points(points: DataFrame, x: str = "lon", y: str = "lat", v: str = "v", order: str = "id") -> DataFrame:
    """(row, col, v) of the cells that hold a point, rows from the greatest latitude, columns
    from the least longitude, at two minutes of arc; of several the last by order."""
    e = points.agg(F.max(y).alias("_top"), F.min(x).alias("_left"))
    whole = lambda c: F.floor(c / RASTER_STEP + 0.5).cast("int")
    at = points.join(F.broadcast(e)).select(whole(F.col("_top") - F.col(y)).alias("row"), whole(F.col(x) - F.col("_left")).alias("col"), F.col(v).alias("v"), F.col(order).alias("o"))
    return at.groupBy("row", "col").agg(F.max_by("v", "o").alias("v"))


def database(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table through JDBC; with a whole-number key it is read in ranges of the key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key is not None:
        link = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
        q = link.getMetaData().getIdentifierQuoteString().strip()
        link.close()
        lo, hi = spark.read.format("jdbc").options(url=url, query=f"SELECT min({q}{key}{q}) AS lo, max({q}{key}{q}) AS hi FROM {table}", **options).load().first()
        if lo is not None:
            reader = reader.options(partitionColumn=key, lowerBound=str(lo), upperBound=str(hi + 1), numPartitions=str(partitions))
    return reader.load()


def colour_map(spark: SparkSession, path: str) -> DataFrame:
    """(i, red, green, blue) from 0 to 1: two lines of heading, then three numbers a line;
    divided by 255 if any is over 1.1."""
    df = lines(spark, path).where("line_no >= 2").withColumn("f", F.split(F.trim("value"), " +")).where(F.size("f") >= 3)
    at = {c: F.coalesce(F.get("f", F.lit(i)).try_cast("double"), F.lit(0.0)) for i, c in enumerate(("red", "green", "blue"))}
    rows = df.select("line_no", *[e.alias(c) for c, e in at.items()])
    top = rows.agg(F.max(F.greatest("red", "green", "blue")).alias("_top"))
    scale = F.when(F.col("_top") > 1.1, 255.0).otherwise(1.0)
    i = F.row_number().over(W.orderBy("line_no")) - 1  # a few hundred colours
    return rows.join(F.broadcast(top)).select(i.alias("i"), *[(F.col(c) / scale).alias(c) for c in at])


def borders(spark: SparkSession, path: str) -> DataFrame:
    """(feature, ring, seq, lon, lat) of the polygons of a GeoJSON file, all their rings."""
    spot = "array<double>"
    kind = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)["features"]).alias("feature", "f"))
    type_, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = F.when(type_ == "Polygon", F.from_json(text, f"array<array<{spot}>>")).when(type_ == "MultiPolygon", F.flatten(F.from_json(text, f"array<array<array<{spot}>>>")))
    f = f.select("feature", F.posexplode(rings).alias("ring", "r"))
    return f.select("feature", "ring", F.posexplode("r").alias("seq", "p")).select("feature", "ring", "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))
