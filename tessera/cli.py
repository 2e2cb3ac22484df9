"""Command line over files or folders of files: every command is one Spark job over a table of images.

    python -m tessera.cli --version
    python -m tessera.cli --probe-input PATH
    python -m tessera.cli --convert PATH FOLDER
    python -m tessera.cli --certified-export REQUEST_ID [CERTIFICATE_SHA256]
    python -m tessera.cli --certified-convert PATH FOLDER FORMAT

Exit codes: 0 all accepted, 64 usage, 65 some input refused, 70 internal fault. Reports are `key=value` lines.
"""

from __future__ import annotations

import hashlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.contracts import records
from tessera.contracts.checks import NONE
from tessera.operators.images import certified_convert
from tessera.sinks import encoders
from tessera.sinks.files import write_files
from tessera.sources.binary import decoded, load

OK, USAGE, DATA, FAULT = 0, 64, 65, 70
VERSION, API = "1.0.0", "api.v1"


def _report(**pairs: object) -> str:
    return "".join(f"{k}={v}\n" for k, v in pairs.items())


def probe(spark: SparkSession, path: str) -> DataFrame:
    """(path, report, accepted): every file is decoded in full, so that accepted ones are readable."""
    files = load(spark, path)
    rows = files.select("path", "length").join(decoded(files).select("path", "format", "error"), "path")
    good = F.concat(F.lit("schema_version=raster-input.v1\nstatus=accepted\nformat="), "format", F.lit("\ninput_bytes="), F.col("length").cast("string"), F.lit("\n"))
    bad = F.concat(F.lit("schema_version=raster-input.v1\nstatus=error\nerror="), records.snake(F.col("error")), F.lit("\n"))
    return rows.select("path", F.when(F.col("error") == NONE, good).otherwise(bad).alias("report"), (F.col("error") == NONE).alias("accepted"))


def convert(spark: SparkSession, path: str) -> DataFrame:
    """(path, error, bytes): decoded files as PAM."""
    rows = decoded(load(spark, path))
    return rows.select("path", "error", encoders.pam(F.col("width"), F.col("height"), F.col("rgba")).alias("bytes"))


def convert_certified(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(path, error, bytes, certificate, ...): decoded files through the certified conversion."""
    rows = decoded(load(spark, path))
    done = certified_convert(rows.where(F.col("error") == NONE), form, keep=("path",))
    refused = rows.where(F.col("error") != NONE).select("path", "error")
    return done.unionByName(refused, allowMissingColumns=True)


def export_certified(spark: SparkSession, request_id: str, digest: str = "") -> DataFrame:
    """(error, report): the chain of contracts without geometry, for one request; a substituted digest is refused."""
    body = spark.range(1).select(encoders.envelope(F.lit("svg"), F.lit(1), F.lit(1)).cast("binary").alias("bytes"))
    source, tail = hashlib.sha256(request_id.encode()).hexdigest(), "toolchain_revision=1\nsample_count=1\nexecution_units=1\n"
    rows = body.withColumn("output_sha256", F.sha2("bytes", 256))
    text = F.concat(F.lit(f"schema_version=1\ncertificate_id={request_id}\ninput_sha256={source}\noutput_sha256="), "output_sha256", F.lit("\n" + tail)).cast("binary")
    rows = rows.withColumn("text", text).withColumn("sha", F.sha2("text", 256))
    rows = rows.withColumn("c", F.expr(f"struct('{VERSION}' AS certificate_id, '1' AS toolchain_revision, '{source}' AS input_sha256, output_sha256, sha AS certificate_sha256, text AS canonical_bytes)"))
    claimed = F.lit(digest) if digest else F.col("sha")
    request = F.struct(F.lit(API).alias("schema_version"), F.lit(request_id).alias("request_id"), F.lit("certified_export").alias("operation"), F.lit(0).alias("input_bytes"), F.octet_length("bytes").alias("output_bytes"), F.lit(1).alias("work_units"), claimed.alias("certificate_sha256"))
    rows = rows.withColumn("r", request).withColumn("error", records.certified_request("r", "c", API))
    return rows.select("error", records.certified_response_report("r", "c", F.col("error"), API).alias("report"))


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    command, *given = argv or ["--version"]
    wanted = {"--version": (0,), "--help": (0,), "--probe-input": (1,), "--convert": (2,), "--certified-export": (1, 2), "--certified-convert": (3,)}
    if command not in wanted or len(given) not in wanted[command] or (command == "--certified-convert" and given[2] not in encoders.FORMATS):
        print("error: unsupported command line", file=sys.stderr)
        return USAGE
    if command == "--help":
        print(__doc__)
        return OK
    if command == "--version":
        print(f"tessera {VERSION}")
        return OK
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if command == "--probe-input":
            rows = probe(spark, given[0]).orderBy("path").toLocalIterator()
            good = [(print(r.report, end=""), r.accepted)[1] for r in rows]
        elif command == "--certified-export":
            rows = export_certified(spark, *given).collect()
            good = [(print(r.report, end=""), r.error == NONE)[1] for r in rows]
        else:
            rows = convert(spark, given[0]) if command == "--convert" else convert_certified(spark, given[0], given[2])
            done = write_files(rows, given[1], "pam" if command == "--convert" else given[2]).orderBy("path").toLocalIterator()
            good = [(print(_report(schema_version="raster-convert.v1", status="success" if r.error == NONE else "error", **({"path": r.written} if r.error == NONE else {"error": r.error})), end=""), r.error == NONE)[1] for r in done]
    except Exception as fault:
        print(f"error: {str(fault)[:300]}", file=sys.stderr)
        return DATA if "PATH_NOT_FOUND" in str(fault) or "does not exist" in str(fault) else FAULT
    return OK if good and all(good) else DATA


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
