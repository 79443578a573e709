"""Command line: the original application's jobs as Spark jobs.

    python -m lendscope.cli train  --tables DIR | --csv PATH [--rejects OUT]  --model OUT --report OUT
    python -m lendscope.cli score  --model DIR --input JSON --output OUT [--format parquet|json] [--id NAME] [--report DIR]
    python -m lendscope.cli stream --model DIR --input DIR --output OUT [--checkpoint DIR] [--id NAME] [--report DIR]
    python -m lendscope.cli stats  --report DIR          # the dataset statistics document
    python -m lendscope.cli model-info --report DIR      # the model summary fields

``train`` replaces the training script (cleaning, encoding, exact split,
forest, evaluation, report); ``score`` and ``stream`` replace the scoring
endpoint for whole batches or a stream of request files (``--id`` names the
request's key, which every answer carries; label codes come from beside the
model, or from a report named with ``--report``); ``stats`` and
``model-info`` print what the two read endpoints returned. Paths may be on
any file system Spark can read; the shared checkpoint folder comes from
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import json
import sys

from .plans import reports, training
from .session import build_session
from .sources import files
from .sources.tables import applications
from .streaming import scoring as stream


def _load_scorer(spark, model_dir: str, report_dir: str | None):
    pipeline, codes = training.load(spark, model_dir)
    return pipeline, reports.encoding_codes(reports.read_report(spark, report_dir)) if report_dir else codes


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="lendscope")
    sub = ap.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    src = t.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder with the orders and customer parquet tables")
    src.add_argument("--csv", help="application CSV with the original header")
    t.add_argument("--rejects", help="train on the rows that are well formed and write the rest here, with file and line")
    t.add_argument("--model", required=True)
    t.add_argument("--report", required=True)
    s = sub.add_parser("score")
    st = sub.add_parser("stream")
    for p in (s, st):
        p.add_argument("--model", required=True)
        p.add_argument("--report", help="take the label codes from this report")
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--id", help="key of a request, a whole number, carried to its answer")
    s.add_argument("--format", default="parquet", choices=["parquet", "json"])
    st.add_argument("--checkpoint")
    for name in ("stats", "model-info"):
        sub.add_parser(name).add_argument("--report", required=True)
    args = ap.parse_args(argv)

    spark = build_session()
    if args.cmd == "train":
        if args.tables:
            raw = applications(spark, args.tables)
        elif args.rejects:
            table = files.scan_applications_csv(spark, args.csv)
            table.rejects.write.mode("overwrite").parquet(args.rejects)
            raw = table.rows.drop("rejects")
        else:
            raw = files.read_applications_csv(spark, args.csv)
        result = training.train(spark, raw)
        training.save(spark, result, args.model, args.report)
        report, scalars = result.report, result.report.scalars
        print(json.dumps({"accuracy": scalars["accuracy"], "accuracy_percent": scalars["accuracy_percent"], "classification_report": report.classification_report,
                          "confusion_matrix": report.confusion_matrix, "feature_importance": {r.feature: r.importance for r in report.importance.collect()}}))
    elif args.cmd == "score":
        pipeline, codes = _load_scorer(spark, args.model, args.report)
        keep = [args.id] if args.id else []
        requests = files.read_scoring_json(spark, args.input, keep)
        out = stream.scored_records(requests, pipeline, codes, keep)
        files.write_scored(out, args.output, args.format)
    elif args.cmd == "stream":
        pipeline, codes = _load_scorer(spark, args.model, args.report)
        q = stream.start_scoring_stream(spark, args.input, pipeline, codes, args.output,
                                        checkpoint=args.checkpoint, keep=[args.id] if args.id else None)
        q.awaitTermination()
    elif args.cmd == "stats":
        row = reports.stats_section(reports.read_report(spark, args.report)).first()
        print(json.dumps(row.asDict(recursive=True)))
    elif args.cmd == "model-info":
        row = reports.model_info(reports.read_report(spark, args.report)).first()
        print(json.dumps(row.asDict(recursive=True)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
