"""Static assets: kinds, rollups, what is referenced, and what another format would save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars as S

#: Extensions of each kind.
KINDS = {
    "svg": (".svg",),
    "image": (".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".avif", ".bmp", ".tiff", ".tif"),
    "font": (".woff", ".woff2", ".ttf", ".otf", ".eot"),
    "video": (".mp4", ".webm", ".mov", ".avi", ".mkv", ".m4v"),
    "audio": (".mp3", ".wav", ".ogg", ".m4a", ".flac", ".aac"),
    "document": (".pdf",),
    "data": (".json", ".xml", ".csv"),
}
#: Percent that WebP saves where only the name of an image is known.
BY_NAME = {"png": 75, "jpg": 30, "jpeg": 30, "gif": 50, "bmp": 95, "tiff": 90, "tif": 90}
#: Sizes from which an asset is large, very large, huge.
LARGE = {"image": (100_000, 500_000, 1_000_000), "svg": (20_000, 50_000), "font": (100_000, 200_000), "video": (5_000_000, 20_000_000)}
#: What serving an asset costs.
SERVING = {"loads": 10_000, "cached": 0.8, "per_gb": 0.08, "co2_per_gb": 0.5}


def kind(path: Column) -> Column:
    ext = S.extension(path)
    told = F.when(ext.isin(*KINDS["svg"]), "svg")
    for name in list(KINDS)[1:]:
        told = told.when(ext.isin(*KINDS[name]), name)
    return told.otherwise("other")


def rollup(assets: DataFrame, by: str = "kind", size: str = "size") -> DataFrame:
    return assets.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("total"), F.max(size).alias("largest"))


def keys(path: Column) -> Column:
    """Names a reference may use for an asset: its path, base name, both without extension, and the path from the root."""
    base = S.basename(path)
    return F.array_distinct(F.array(path, F.concat(F.lit("/"), path), base, S.strip_extension(base), S.strip_extension(path)))


def unreferenced(assets: DataFrame, references: DataFrame) -> DataFrame:
    """Assets (project, path, ...) that no reference (project, name) names by any key."""
    each = assets.select("project", "path", F.explode(keys(F.col("path"))).alias("name"))
    hit = each.join(references.select("project", "name").distinct(), ["project", "name"], "left_semi").select("project", "path").distinct()
    return assets.join(hit, ["project", "path"], "left_anti")


def photographic(fmt: Column, width: Column, height: Column, depth: Column, size: Column) -> Column:
    return (depth >= 8) & (width > 400) & (height > 400) & fmt.isin("jpeg", "png") & (size > 50_000)


def _advice(percent: Column, fmt: Column, size: Column) -> Column:
    """struct<format, percent, saved, optimised>; null where there is nothing to gain."""
    after = S.half_up(size * (1 - percent / 100.0)).cast("long")
    return F.when(percent >= 10, F.struct(fmt.alias("format"), percent.cast("int").alias("percent"), (size - after).alias("saved"), after.alias("optimised")))


def image_advice(fmt: Column, alpha: Column, photo: Column, animated: Column, size: Column) -> Column:
    """The better format of an image whose header was read."""
    f = F.lower(fmt)
    percent = (
        F.when((f == "png") & alpha, 75).when((f == "png") & photo, 92).when(f == "png", 70).when(f.isin("jpeg", "jpg"), 30)
        .when((f == "gif") & animated, 50).when(f == "gif", 60).when(f.isin("bmp", "tiff", "tif"), 95).when((f == "webp") & (size > 500_000), 25)
    )
    return _advice(percent, F.when(f == "webp", "avif").otherwise("webp"), size)


def named_advice(path: Column, size: Column) -> Column:
    """The better format of an image of which only the name is known."""
    known = F.create_map(*(F.lit(x) for k, v in BY_NAME.items() for x in ("." + k, v)))
    return _advice(F.try_element_at(known, S.extension(path)), F.lit("webp"), size)


def font_advice(path: Column, size: Column) -> Column:
    ext = S.extension(path)
    return _advice(F.when(ext.isin(".ttf", ".otf"), 50).when(ext == ".woff", 30).when(ext == ".eot", 70), F.lit("woff2"), size)


def video_advice(path: Column, size: Column) -> Column:
    return _advice(F.when(S.extension(path).isin(".mov", ".avi", ".mkv"), 50), F.lit("mp4"), size)


def svg_advice(content: Column, size: Column) -> Column:
    """What a minifier would save: 35 percent, 10 more with an editor's metadata, 5 more with over two comments."""
    metadata = content.contains("<metadata") | content.contains("<!-- Generator") | content.contains("xmlns:sodipodi")
    comments = F.regexp_count(content, F.lit(r"(?s)<!--.*?-->"))
    return _advice(35 + F.when(metadata, 10).otherwise(0) + F.when(comments > 2, 5).otherwise(0), F.lit("svg"), size)


def svg_facts(content: Column) -> dict[str, Column]:
    n = lambda pattern: F.regexp_count(content, F.lit(pattern))
    box = F.split(F.regexp_extract(content, r"""viewBox=["']([^"']+)["']""", 1), r"\s+")
    side = lambda at, name: F.coalesce(F.when(F.size(box) == 4, F.get(box, F.lit(at)).try_cast("double")), F.regexp_extract(content, rf"""{name}=["'](\d+)""", 1).try_cast("double"))
    return {
        "comments": n(r"(?s)<!--.*?-->"), "paths": n("(?i)<path"), "elements": n("(?i)<[a-z]"), "inline_styles": content.contains('style="'),
        "embedded_images": content.contains("data:image"), "filters": content.contains("<filter"), "width": side(2, "width"), "height": side(3, "height"),
    }


def advice(path: Column, size: Column) -> Column:
    """The better format of any asset by its name: images, fonts, videos."""
    return F.coalesce(named_advice(path, size), font_advice(path, size), video_advice(path, size))


def priority(kind_: Column, size: Column) -> Column:
    told = F.lit(None).cast("string")
    for name, limits in LARGE.items():
        told = F.when(kind_ == name, F.when(size >= limits[1], "high").when(size >= limits[0], "medium").otherwise("low")).otherwise(told)
    return told


def format_savings(assets: DataFrame, size: str = "size") -> DataFrame:
    """The assets that another format would make smaller: format, percent, saved, the largest saving first."""
    found = assets.withColumn("_better", advice(F.col("path"), F.col(size))).filter("_better IS NOT NULL")
    return found.select("*", "_better.format", "_better.percent", "_better.saved").drop("_better").orderBy(F.desc("saved"), "path")


def serving_cost(size: Column) -> dict[str, Column]:
    """GB, cost and kg of CO2 a month of an asset that is served."""
    gb = size * SERVING["loads"] * (1 - SERVING["cached"]) / float(1 << 30)
    return {"gb": gb, "cost": gb * SERVING["per_gb"], "co2_kg": gb * SERVING["co2_per_gb"]}


def dimensions(content: Column) -> Column:
    """struct<format, width, height> from the header of a PNG, GIF or BMP; JPEG by ``jpeg_dimensions``."""
    whole = F.hex(F.substring(content, 1, 32))
    number = lambda at, n: F.conv(F.substring(whole, 2 * at + 1, 2 * n), 16, 10).cast("int")
    turned = lambda at, n: F.conv(F.concat(*(F.substring(whole, 2 * (at + k) + 1, 2) for k in reversed(range(n)))), 16, 10).cast("int")
    told = lambda f, w, h: F.struct(F.lit(f).alias("format"), w.alias("width"), h.alias("height"))
    return (
        F.when(whole.startswith("89504E470D0A1A0A"), told("png", number(16, 4), number(20, 4)))
        .when(whole.rlike("^47494638(37|39)61"), told("gif", turned(6, 2), turned(8, 2)))
        .when(whole.startswith("424D"), told("bmp", turned(18, 4), turned(22, 4)))
        .when(whole.startswith("FFD8"), jpeg_dimensions(content))
    )


def jpeg_dimensions(content: Column) -> Column:
    """From the first frame header, found by going from marker segment to marker segment."""
    start = F.struct(F.lit(3).alias("at"), F.lit(None).cast("string").alias("frame"))

    def step(acc, _):
        head = F.hex(F.substring(content, acc["at"], F.lit(9)))
        size = F.conv(F.substring(head, 5, 4), 16, 10).cast("int")
        frame = head.rlike("^FF(C[0-35-79A-BD-F])")
        moves = acc["frame"].isNull() & head.rlike("^FF[^0D]|^FFD[A-F]|^FFDB") & ~frame & (size >= 2)
        return F.struct((acc["at"] + F.when(moves, size + 2).otherwise(0)).cast("int").alias("at"), F.coalesce(acc["frame"], F.when(frame, head)).alias("frame"))

    frame = F.aggregate(F.sequence(F.lit(1), F.lit(256)), start, step)["frame"]
    side = lambda at: F.conv(F.substring(frame, at, 4), 16, 10).cast("int")
    return F.struct(F.lit("jpeg").alias("format"), side(15).alias("width"), side(11).alias("height"))


def quick_wins(assets: DataFrame, n: int = 5) -> DataFrame:
    """The assets (project, path, size) that save most by another format, and how much of all that is."""
    return format_savings(assets).limit(n)


def references(files: DataFrame) -> DataFrame:
    """project, name: quoted or url() strings in code, markup and style that end in an asset's extension."""
    every = "|".join(e[1:] for group in KINDS.values() for e in group)
    pattern = rf"""["'(]([^"'()\s]+\.(?:{every}))[?#"')]"""
    named = files.select("project", F.explode(F.regexp_extract_all("content", F.lit(pattern), 1)).alias("path"))
    tail = F.regexp_replace("path", r"^(\.{1,2}/|@/|~/|/)+", "")
    return named.select("project", F.explode(F.array_distinct(F.array(tail, S.basename(F.col("path"))))).alias("name")).distinct()


def css_rules(files: DataFrame) -> DataFrame:
    """project, file, rules, selectors of style sheets: what stands before each opening brace since the last brace."""
    before = F.split("content", r"\{", -1)
    pieces = F.slice(before, F.lit(1), F.greatest(F.size(before) - 1, F.lit(0)))
    found = F.filter(F.transform(pieces, lambda s: F.trim(F.substring_index(s, "}", -1))), lambda s: s != "")
    return files.select("project", "file", F.size(found).alias("rules"), found.alias("selectors"))


def bundles(files: DataFrame, build_dirs=("dist", "build", "out", ".next", "public/build")) -> DataFrame:
    """Sizes by kind in the first build directory that a project has."""
    order = F.array(*map(F.lit, build_dirs))
    first = F.array_min(F.transform(F.filter(order, lambda d: F.col("file").startswith(F.concat(d, F.lit("/")))), lambda d: F.array_position(order, d)))
    own = files.withColumn("_dir", first).filter("_dir IS NOT NULL AND file NOT LIKE '%.map'")
    least = own.groupBy("project").agg(F.min("_dir").alias("_least"))
    chosen = own.join(least, "project").filter("_dir = _least")
    ext = S.extension(F.col("file"))
    of = lambda *e: F.sum(F.when(ext.isin(*e), F.col("size")).otherwise(0))
    return chosen.groupBy("project").agg(of(".js", ".mjs", ".cjs").alias("js"), of(".css").alias("css"), of(".html").alias("html"), F.sum("size").alias("total"), F.count(F.lit(1)).alias("files"))


def logs(files: DataFrame) -> DataFrame:
    """Log files by directory, the largest first: critical from a file above 100 MiB, warning from one above 10 MiB."""
    own = files.filter(F.lower("file").rlike(r"\.logs?(\.\d+|\.gz)?$"))
    level = F.when(F.max("size") > 100 << 20, "critical").when(F.max("size") > 10 << 20, "warning").otherwise("ok")
    per = own.groupBy("project", S.dirname(F.col("file")).alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total"), level.alias("level"))
    return per.orderBy(F.desc("total"), "project", "directory")


def too_many_logs(directories: DataFrame) -> DataFrame:
    """Projects whose logs are above 50 MiB in all."""
    return directories.groupBy("project").agg(F.sum("files").alias("files"), F.sum("total").alias("total")).filter(F.col("total") > 50 << 20)
