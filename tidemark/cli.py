"""python -m tidemark.cli {train,detect,report,run}: exit code 0 on success, 1 on an error, 130 when interrupted."""

from __future__ import annotations

import argparse
import logging
import logging.handlers
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.config import Settings, SettingsError
from tidemark.errors import TidemarkError
from tidemark.plans import workflows
from tidemark.sources.pcap import read_captures
from tidemark.sources.results import read_results, write_json, write_matrix, write_results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--config")
    p.add_argument("--log-file")
    p.add_argument("--verbose", action="store_true")
    commands = p.add_subparsers(dest="command", required=True)
    for name, words in (("train", ("source", "bundle")), ("detect", ("source", "bundle", "out")), ("report", ("results", "out")), ("run", ("source", "bundle", "out")), ("matrix", ("source", "out"))):
        c = commands.add_parser(name)
        for w in words:
            c.add_argument(w)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        settings = Settings.load(args.config)
        handlers = [logging.StreamHandler()]
        if args.log_file:
            handlers.append(logging.handlers.RotatingFileHandler(args.log_file, maxBytes=settings.logging.file_max_bytes, backupCount=settings.logging.file_backup_count))
        logging.basicConfig(level="DEBUG" if args.verbose else settings.logging.level, handlers=handlers, force=True)
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if args.command == "report":
            tables = workflows.report(read_results(spark, args.results), settings)
            if args.out.endswith(".pdf"):
                return 0 if workflows.pdf(tables, args.out, settings) else 1
            with Path(args.out).open("w") as f:
                f.writelines(line + "\n" for line in workflows.lines(tables, settings))
            return 0
        packets = read_captures(spark, args.source, settings.ingestion.bucket_seconds)
        if args.command == "train":
            workflows.train(packets, settings, args.source, f"{args.bundle.rstrip('/')}/audit").save(spark, args.bundle)
        elif args.command == "matrix":
            from tidemark.operators.windows import window_features

            write_matrix(window_features(packets), args.out)
        else:
            bundle = workflows.Bundle.load(spark, args.bundle)
            if args.command == "run":
                workflows.run(spark, packets, bundle, args.out, settings)
            else:
                began = time.time()
                write_results(workflows.detect(packets, bundle, settings), args.out)
                took = time.time() - began
                write_json(spark, f"{args.out.rstrip('/')}-summary", workflows.detection_summary(read_results(spark, args.out), took))
    except KeyboardInterrupt:
        return 130
    except (TidemarkError, SettingsError, OSError) as e:
        logging.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
