"""The dump step: tables as text files with a descriptor beside them.

Executors write a table's parts in parallel, in row order. Up to ``merge_bytes`` in all
they are then joined into one file by copying bytes, whose hash is taken on the way;
larger tables stay a folder of parts, which the descriptor says and load reads again.
``single_file`` true or false decides it for tables of any size.
"""

from __future__ import annotations

import json
import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import scratch
from tablewright.package import ROW_ID, Package, Resource, StepError, from_frame, quoted
from tablewright.schema import cast_resource, output_text
from tablewright.sources.load import session

#: Prefixes with more files than this are never cleared.
MOST_DELETED = 10
#: Tables of more bytes stay in parts: one file's bytes pass through the driver.
MERGE_BYTES = 1 << 30
# Identifiers of the standard names of latitude and longitude.
LATITUDE, LONGITUDE = "730", "731"


def dump_to_path(p: Package, **options) -> Package:
    return _dump(p, options.pop("out-path", options.pop("out_path", ".")), options)


def dump_to_s3(p: Package, bucket_name: str | None = None, prefix: str = "", **options) -> Package:
    if not bucket_name:
        raise StepError("bucket_name is required")
    root = bucket_name if "://" in bucket_name or bucket_name.startswith("/") else f"s3a://{bucket_name}"
    return _dump(p, "/".join(x for x in (root.rstrip("/"), prefix.strip("/")) if x), options)


def _dump(p: Package, root: str, options: dict) -> Package:
    spark = session()
    fmt = options.get("format", "csv")
    if fmt not in ("csv", "json"):
        raise StepError(f"Unknown output format {fmt!r}: csv or json")
    if options.get("delete"):
        _clear(spark, root)
    out, stats, meta = [], {}, dict(p.meta)
    resources = list(p.resources)
    if options.get("dump_unique_lat_lon"):
        resources += [u for r in p.resources if (u := unique_lat_lon(r)) is not None]
    written = []
    for r in resources:
        r = cast_resource(r)
        path = os.path.splitext(str(r.descriptor.get("path", r.name)))[0] + f".{fmt}"
        props = write_table(r, f"{root}/{path}", fmt, options)
        stats[r.name] = {k: v for k, v in props.items() if k != "dialect"}
        r = replace(r, descriptor=r.descriptor | {"path": path, "format": fmt, "encoding": "utf-8"} | props)
        prop = options.get("temporal_format_property")
        if prop:
            r = replace(r, fields=tuple(f | {"format": f[prop]} if f.get("type") in ("date", "datetime", "time") and prop in f else f for f in r.fields))
        written.append(r)
        if r.name in p.names:
            limit = options.get("limit_yield")
            out.append(replace(r, df=r.df.orderBy(ROW_ID).limit(int(limit))) if limit else r)
    totals = {"count_of_rows": sum(s["count_of_rows"] for s in stats.values()), "bytes": sum(s["bytes"] for s in stats.values())}
    if options.get("data_manager"):
        meta["dataManager"] = options["data_manager"]
    described = meta | totals | {"resources": [_plain(r.public()) for r in written]}
    write_text(spark, f"{root}/datapackage.json", json.dumps(described, indent=2, default=str))
    if options.get("save_pipeline_spec") and options.get("pipeline_spec"):
        write_text(spark, f"{root}/pipeline-spec.yaml", options["pipeline_spec"])
    return replace(p, resources=tuple(out), meta=meta, stats=p.stats | {"dump_path": root, "resources": stats} | totals)


def _plain(d: dict) -> dict:
    return {k: v for k, v in d.items() if not k.startswith("__")}


def _clear(spark: SparkSession, root: str) -> None:
    where, fs = scratch.file_system(spark, root)
    if not fs.exists(where):
        return
    if fs.getContentSummary(where).getFileCount() >= MOST_DELETED:
        raise StepError(f"{root} holds {MOST_DELETED} files or more: it isn't cleared")
    fs.delete(where, True)


def csv_line(r: Resource, temporal_property: str | None) -> F.Column:
    cells = []
    for f in r.fields:
        t = output_text(r, f, temporal_property or "outputFormat")
        cells.append(F.when(t.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t))
    line = F.concat_ws(",", *cells)
    return F.when(line == "", '""').otherwise(line) if len(cells) == 1 else line


def json_line(r: Resource) -> F.Column:
    cells = []
    for f in sorted(r.fields, key=lambda f: f["name"]):
        kind = r.dtype(f["name"])
        temporal = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
        col = F.when(quoted(f["name"]).isNotNull(), output_text(r, f)) if temporal else quoted(f["name"])
        if isinstance(kind, T.DecimalType):  # as many digits as there are
            col = F.parse_json(F.when(col.isNotNull(), output_text(r, f)))
        cells.append(col.alias(f["name"]))
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def write_table(r: Resource, path: str, fmt: str, options: dict) -> dict:
    """Write one table; its row count, bytes, hash (of single files) and, of parts, dialect."""
    spark = r.df.sparkSession
    if fmt == "csv":
        titles = [f.get("title", f["name"]) if options.get("use_titles") else f["name"] for f in r.fields]
        quote = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\r\n') else s
        lines, first, last, skip = csv_line(r, options.get("temporal_format_property")), ",".join(map(quote, titles)) + "\n", "", 0
        joined = lines
    else:
        lines, first, last, skip = json_line(r), "[", "]", 1
        joined = F.concat(F.lit(","), lines)
    ordered = r.df.orderBy(ROW_ID) if options.get("ordered", True) else r.df
    from pyspark.sql import Observation

    def written(line: F.Column, where: str) -> int:
        """Rows written."""
        seen = Observation()
        ordered.select(line.alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(where, lineSep="\n")
        return seen.get["n"]

    single, most = options.get("single_file"), int(options.get("merge_bytes", MERGE_BYTES))
    if single is not False:
        parts = scratch.folder(spark, "parts")
        rows = written(joined, parts)
        if single or _size(spark, parts) <= most:
            digest, size = merge(spark, parts, path, first, last, skip)
            scratch.delete(spark, parts)
            return {"count_of_rows": rows, "bytes": size, "hash": digest}
        scratch.delete(spark, parts)
    rows = written(lines, path)
    return {"count_of_rows": rows, "bytes": _size(spark, path), "hash": None, "dialect": {"parts": True, "header": False}}


def _size(spark: SparkSession, path: str) -> int:
    where, fs = scratch.file_system(spark, path)
    return fs.getContentSummary(where).getLength()


def merge(spark: SparkSession, parts: str, path: str, first: str, last: str, skip: int) -> tuple[str, int]:
    """Join part files in order below one header, byte by byte. ``skip``: bytes that the first of them loses."""
    jvm = spark.sparkContext._jvm
    target, to = scratch.file_system(spark, path)
    source, at = scratch.file_system(spark, parts)
    md5 = jvm.java.security.MessageDigest.getInstance("MD5")
    out = jvm.java.security.DigestOutputStream(to.create(target, True), md5)
    try:
        out.write(bytearray(first.encode()))
        found = sorted(str(s.getPath()) for s in at.listStatus(source) if s.getPath().getName().startswith("part-") and s.getLen() > 0)
        for name in found:
            stream = at.open(jvm.org.apache.hadoop.fs.Path(name))
            if skip:
                stream.seek(skip)
                skip = 0
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            stream.close()
        out.write(bytearray(last.encode()))
    finally:
        out.close()
    if path.startswith("/") or path.startswith("file:"):
        to.setPermission(target, jvm.org.apache.hadoop.fs.permission.FsPermission("775"))
    return bytes(md5.digest()).hex(), to.getFileStatus(target).getLen()


def write_text(spark: SparkSession, path: str, content: str | bytes) -> None:
    target, fs = scratch.file_system(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()


def _primary(r: Resource, standard_name: str) -> str | None:
    """The field whose metadata call it the table's main one of that standard name."""
    for f in r.fields:
        for v in f.values():
            if isinstance(v, dict) and v.get("standard_name_id") == standard_name and v.get("is_primary"):
                return f["name"]
    return None


def unique_lat_lon(r: Resource) -> Resource | None:
    """The distinct pairs of a table's primary latitude and longitude; None if it lacks one."""
    lat, lon = _primary(r, LATITUDE), _primary(r, LONGITUDE)
    return distinct_pairs(r, lat, lon) if lat and lon else None


def distinct_pairs(r: Resource, lat: str, lon: str) -> Resource:
    r = cast_resource(r)
    text = lambda n, out: output_text(r, r.field(n)).alias(out)
    pairs: DataFrame = r.df.select(text(lat, "latitude"), text(lon, "longitude")).distinct()
    return from_frame(f"{r.name}.unique_lat_lon", pairs, ["latitude", "longitude"], {"unique_lat_lon": True})
