"""python -m tidemark audit PATH | gate FOLDER [--manifest FILE] [--min-score N] [--topic T]... | ingest FOLDER --catalog FOLDER"""

from __future__ import annotations

import argparse
import json
import sys


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("what", choices=("audit", "gate", "ingest"))
    p.add_argument("path")
    p.add_argument("--manifest")
    p.add_argument("--min-score", type=float)
    p.add_argument("--topic", action="append", default=[])
    p.add_argument("--catalog")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(args)
    from pyspark.sql import SparkSession

    from tidemark import catalog
    from tidemark.operators.gate import Policy

    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    if a.what == "audit":
        found = catalog.audit(spark, a.path, a.topic or None)
        for r in found["recordings"].select("mission_id").orderBy("mission_id").toLocalIterator():
            print(catalog.markdown(found, r.mission_id))
        return 0
    if a.what == "gate":
        out = catalog.gate_folder(spark, a.path, Policy(score=a.min_score, topics=tuple(a.topic)), a.manifest)
        print(json.dumps(out["summary"]))
        return out["exit"]
    if not a.catalog:
        p.error("ingest needs --catalog")
    errors = catalog.index(spark, a.path, a.catalog, a.force).collect()
    print(json.dumps({"missions": catalog.read(spark, a.catalog, "missions").count(), "errors": {r.path: r.error for r in errors}}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
