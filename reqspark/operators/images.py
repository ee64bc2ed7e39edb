"""Images in artifacts: embedded, referenced, attached; formats, checks, links. Bytes are never shuffled: jobs go by keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTENSIONS = ["png", "jpg", "jpeg", "gif", "bmp", "svg", "tiff", "webp"]
FORMATS = ["png", "jpeg", "jpg", "gif", "bmp", "svg", "tiff", "webp"]
EMBEDDED = r"(?i)<(?:\w+:)?img[^>]*?src=\"data:image/([^;\"]+);base64,([^\"]*)\""
OBJECT = r"(?i)<(?:\w+:)?object\b[^>]*>"
REFERENCE = r"(?i)<(?:\w+:)?img[^>]*?src=\"(?!data:)([^\"]+)\""


def embedded_images(rows: DataFrame, key: str) -> DataFrame:
    """key, place, format (unknown if not listed), content, size_bytes, hash, error of every embedded image."""
    kinds = F.regexp_extract_all("text", F.lit(EMBEDDED), F.lit(1))
    bodies = F.regexp_extract_all("text", F.lit(EMBEDDED), F.lit(2))
    found = rows.select(key, F.posexplode(F.arrays_zip(kinds.alias("kind"), bodies.alias("body"))).alias("place", "image"))
    kind, content = F.lower("image.kind"), F.try_to_binary(F.col("image.body"), F.lit("base64"))
    found = found.select(key, "place", F.when(kind.isin(FORMATS), kind).otherwise("unknown").alias("format"), content.alias("content"))
    return found.select("*", F.octet_length("content").alias("size_bytes"), F.sha2("content", 256).alias("hash"), F.when(F.col("content").isNull(), "undecodable").alias("error"))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?i)\b{name}=\"([^\"]*)\"", 1)


def _by_extension(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for e in EXTENSIONS:
        out = out.when(F.contains(F.lower(name), F.lit(f".{e}")), e)
    return out


def object_images(rows: DataFrame, key: str) -> DataFrame:
    """key, place, object_type, object_data, format of objects that are images by type or by name."""
    found = rows.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(OBJECT), F.lit(0))).alias("place", "tag"))
    found = found.select(key, "place", _attribute(F.col("tag"), "type").alias("object_type"), _attribute(F.col("tag"), "data").alias("object_data"))
    found = found.withColumn("format", _by_extension(F.col("object_data")))
    return found.where(F.contains("object_type", F.lit("image")) | F.col("format").isNotNull()).withColumn("format", F.coalesce("format", F.lit("unknown")))


def image_format(name: Column, content: Column) -> Column:
    """By extension, else by the first bytes, else unknown."""
    head = F.hex(F.substring(content, 1, 8))
    by_name = F.when(F.lit(False), "")
    for e in EXTENSIONS:
        by_name = by_name.when(F.lower(name).endswith(f".{e}"), e)
    magic = (
        F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.rlike("^474946383[79]61"), "gif").when(head.startswith("424D"), "bmp")
        .when(F.contains(F.hex(F.substring(content, 1, 100)), F.lit("3C737667")), "svg")
    )
    return F.coalesce(by_name, magic, F.lit("unknown"))


def _number(content: Column, start: int | Column, length: int, little: bool | Column) -> Column:
    """The unsigned integer of length bytes from start (from 1); null beyond the end."""
    parts = [F.hex(F.substring(content, F.lit(start) + k, F.lit(1))) for k in range(length)]
    order = lambda p: F.conv(F.concat(*p), 16, 10).cast("int")
    value = F.when(little, order(parts[::-1])).otherwise(order(parts)) if isinstance(little, Column) else order(parts[::-1] if little else parts)
    return F.when(F.octet_length(content) >= F.lit(start) + (length - 1), value)


SIZE = "struct<at:int,width:int,height:int>"


def _jpeg_size(content: Column) -> Column:
    """Width and height of the frame header that the chain of segments leads to; each segment tells where the next one starts."""
    # each step passes a byte FF, so there are no more steps than those
    steps = F.floor((F.length(F.hex(content)) - F.length(F.replace(F.hex(content), F.lit("FF"), F.lit("")))) / 2)
    pair = lambda at: F.hex(F.substring(content, at, F.lit(2)))

    def step(s: Column, _: Column) -> Column:
        at, mark = s["at"], pair(s["at"])
        to = lambda where, width=F.lit(None).cast("int"), height=F.lit(None).cast("int"): F.struct(where.cast("int").alias("at"), width.alias("width"), height.alias("height"))
        frame = mark.rlike("^FFC[0-35-79A-BD-F]$")
        size = _number(content, at + 2, 2, False)
        return (
            F.when(at.isNull(), s).when(frame, to(F.lit(None), _number(content, at + 7, 2, False), _number(content, at + 5, 2, False)))
            .when(mark == "FFFF", to(at + 1)).when(mark.rlike("^FF(01|D[0-8])$"), to(at + 2)).when(mark.rlike("^FF[^0]") & (size >= 2), to(at + 2 + size)).otherwise(to(F.lit(None)))
        )

    start = F.struct(F.lit(3).alias("at"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), steps.cast("int"))), start.cast(SIZE), lambda s, x: step(s, x).cast(SIZE))


def _tiff_size(content: Column) -> Column:
    """Width and height among the entries of the first directory."""
    little = F.hex(F.substring(content, 1, 2)) == "4949"
    first = _number(content, 5, 4, little) + 1
    n = _number(content, first, 2, little)
    entry = lambda k: first + 2 + 12 * k
    # short values stand in the first two bytes of their field
    value = lambda k: F.when(_number(content, entry(k) + 2, 2, little) == 3, _number(content, entry(k) + 8, 2, little)).otherwise(_number(content, entry(k) + 8, 4, little))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    of = lambda tag: F.get(F.transform(F.filter(every, lambda k: _number(content, entry(k), 2, little) == tag), value), F.lit(0))
    return F.struct(F.lit(None).cast("int").alias("at"), of(256).alias("width"), of(257).alias("height"))


def _webp_size(content: Column) -> Column:
    """Lossy, lossless and extended forms."""
    form = F.decode(F.substring(content, 13, 4), "ISO-8859-1")
    bits = _number(content, 22, 4, True).cast("long")
    raw = F.conv(F.concat(*(F.hex(F.substring(content, 25 - k, 1)) for k in range(4))), 16, 10).cast("long")
    width = F.when(form == "VP8 ", _number(content, 27, 2, True).bitwiseAND(0x3FFF)).when(form == "VP8L", (raw.bitwiseAND(0x3FFF) + 1).cast("int")).when(form == "VP8X", _number(content, 25, 3, True) + 1)
    height = F.when(form == "VP8 ", _number(content, 29, 2, True).bitwiseAND(0x3FFF)).when(form == "VP8L", (F.shiftright(raw, 14).bitwiseAND(0x3FFF) + 1).cast("int")).when(form == "VP8X", _number(content, 28, 3, True) + 1)
    return F.struct(F.lit(None).cast("int").alias("at"), width.alias("width"), height.alias("height"))


def image_size(content: Column) -> Column:
    """width and height by what the bytes are (PNG, GIF, BMP, JPEG, TIFF, WebP), null where they can't be read."""
    head = F.hex(F.substring(content, 1, 12))
    fixed = lambda at, n, step, little: F.struct(F.lit(None).cast("int").alias("at"), _number(content, at, n, little).alias("width"), _number(content, at + step, n, little).alias("height"))
    found = (
        F.when(head.startswith("89504E470D0A1A0A"), fixed(17, 4, 4, False)).when(head.rlike("^474946383[79]61"), fixed(7, 2, 2, True)).when(head.startswith("424D"), fixed(19, 4, 4, True))
        .when(head.startswith("FFD8FF"), _jpeg_size(content)).when(head.rlike("^(49492A00|4D4D002A)"), _tiff_size(content)).when(head.rlike("^52494646.{8}57454250"), _webp_size(content))
    )
    return found.cast(SIZE)


def image_checks(rows: DataFrame) -> DataFrame:
    """Adds width, height, warnings, and error (unreadable if the bytes tell no size) to rows with content."""
    rows = rows.withColumn("size_", image_size(F.col("content")))
    whole = F.col("size_.width").isNotNull() & F.col("size_.height").isNotNull()
    rows = rows.withColumns({"width": F.when(whole, F.col("size_.width")), "height": F.when(whole, F.col("size_.height"))}).drop("size_")
    long, short = F.greatest("width", "height"), F.least("width", "height")
    warnings = F.array_compact(
        F.array(
            F.when(long > 4096, "larger than 4096 pixels"), F.when(short < 32, "smaller than 32 pixels"), F.when(long > 10 * F.greatest(short, F.lit(1)), "aspect ratio above 10"),
            F.when(F.octet_length("content") > 10 * 1024 * 1024, "larger than 10 MB"),
        )
    )
    return rows.withColumn("warnings", warnings).withColumn("error", F.when(F.col("width").isNull(), "unreadable"))


def image_report(attached: DataFrame, embedded: DataFrame, objects: DataFrame) -> DataFrame:
    """source_file, total, external, embedded (in texts, and objects), saved, failed: attached images have source_file and content,
    embedded ones source_file and error, objects source_file. What has bytes is saved, what can't be decoded has failed."""
    one = lambda rows, kind, saved, failed: rows.select("source_file", F.lit(kind).alias("kind"), saved.alias("saved"), failed.alias("failed"))
    no, has = F.lit(False), F.col("content").isNotNull()
    rows = one(attached, "external", has, ~has).union(one(embedded, "embedded", F.col("error").isNull(), F.col("error").isNotNull())).union(one(objects, "embedded", no, no))
    of = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    return rows.groupBy("source_file").agg(F.count("*").alias("total"), of("external"), of("embedded"), F.count_if("saved").alias("saved"), F.count_if("failed").alias("failed"))


def route_model(images: Column, vision: bool | Column = True) -> Column:
    """vision for a requirement with an image whose bytes are saved (images have saved_path), if vision is enabled; else text."""
    saved = F.exists(images, lambda x: F.coalesce(x["saved_path"], F.lit("")) != "")
    return F.when(F.coalesce(saved, F.lit(False)) & vision, "vision").otherwise("text")


def link_images(artifacts: DataFrame, images: DataFrame) -> DataFrame:
    """source_file, id, images (ids in the order of references): artifacts (source_file, id, text) joined to images
    (source_file, ref_key, image_id) by hash, file name or path."""
    embedded = F.transform(F.regexp_extract_all("text", F.lit(EMBEDDED), F.lit(2)), lambda x: F.sha2(F.try_to_binary(x, F.lit("base64")), 256))
    named = F.transform(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1)), lambda x: F.element_at(F.split(x, "/"), -1))
    data = F.filter(F.transform(F.regexp_extract_all("text", F.lit(OBJECT), F.lit(0)), lambda t: _attribute(t, "data")), lambda x: x != "")
    refs = artifacts.select("source_file", "id", F.posexplode(F.concat(embedded, named, data)).alias("place", "ref_key"))
    linked = refs.join(images.select("source_file", "ref_key", "image_id"), ["source_file", "ref_key"]).groupBy("source_file", "id").agg(F.sort_array(F.collect_list(F.struct("place", "image_id"))).alias("found"))
    rows = artifacts.select("source_file", "id").join(linked, ["source_file", "id"], "left")
    return rows.select("source_file", "id", F.coalesce(F.transform("found", lambda x: x["image_id"]), F.array().cast("array<string>")).alias("images"))


def safe_name(path: Column) -> Column:
    """The last part of a path, without characters that file systems forbid."""
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r'[<>:"/\\|?*]', "_")
