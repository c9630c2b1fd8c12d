"""Command line: python -m quantloom COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quantloom import api
from quantloom.operators.export import Thresholds
from quantloom.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quantloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *stores: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        for s in stores:
            c.add_argument(s)
        return c

    c = command("score", "learn or apply a score on a flat table", "table", "out")
    c.add_argument("--classifier", choices=["lda", "svm", "trees"], default="lda")
    c.add_argument("--group", default="group_id")
    c.add_argument("--ties", nargs="*", default=[])
    c.add_argument("--main")
    c.add_argument("--weights")
    c.add_argument("--folds", type=int, default=10)
    c.add_argument("--rounds", type=int, default=10)
    c.add_argument("--fraction", type=float, default=1.0)
    c.add_argument("--tune", action="store_true")
    c = command("infer", "error control of entities in a context", "table", "out")
    c.add_argument("--entity", default="peptide_id")
    c.add_argument("--context", choices=["global", "experiment-wide", "run-specific"], default="global")
    c = command("export", "long table of identified features", "store", "out")
    c.add_argument("--qvalue", type=float, default=0.05)
    c.add_argument("--peptide-qvalue", type=float, default=0.01)
    c.add_argument("--decoys", action="store_true")
    c = command("merge", "one store of several", "out")
    c.add_argument("stores", nargs="+")
    c.add_argument("--same-run", type=int)
    c = command("subsample", "a share of the precursors", "store", "out")
    c.add_argument("--share", type=float, default=0.1)
    command("reduce", "first ranks only", "store", "out")
    command("split", "partitions by run", "store", "out")
    c = command("filter", "features that pass filters", "store", "out")
    c.add_argument("--runs", nargs="*", type=int)
    c.add_argument("--peptides", nargs="*")
    c.add_argument("--peptide-qvalue", type=float)
    c.add_argument("--protein-qvalue", type=float)
    c.add_argument("--gene-qvalue", type=float)
    c.add_argument("--ms2-qvalue", type=float)
    c.add_argument("--no-decoys", action="store_true")
    command("backpropagate", "context scores of a merged store into a run's", "store", "merged", "out")
    command("statistics", "identifications per run", "store")
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "score":
        source = readers.read_tsv(spark, a.table) if a.table.endswith((".tsv", ".txt", ".csv")) else readers.read_parquet(spark, a.table)
        weights = spark.read.parquet(a.weights) if a.weights else None
        scored, model = api.score(source, a.group, "decoy", a.ties, a.main, a.classifier, a.folds, a.rounds, a.fraction, weights, tune=a.tune)
        writers.write_parquet(scored, f"{a.out}/scored.parquet")
        writers.write_parquet(model, f"{a.out}/weights.parquet")
    elif a.command == "infer":
        writers.write_context(api.infer_entities(readers.read_parquet(spark, a.table), a.entity, a.context), a.out)
    elif a.command == "export":
        writers.write_text(api.export_tsv(api.load(spark, a.store), Thresholds(qvalue=a.qvalue, peptide_qvalue=a.peptide_qvalue, decoys=a.decoys)), a.out)
    elif a.command == "merge":
        api.save(api.merge([api.load(spark, s) for s in a.stores], a.same_run), a.out)
    elif a.command == "subsample":
        api.save(api.subsample(api.load(spark, a.store), a.share), a.out)
    elif a.command == "reduce":
        api.save(api.reduce(api.load(spark, a.store)), a.out)
    elif a.command == "split":
        api.split(api.load(spark, a.store), a.out)
    elif a.command == "filter":
        api.save(api.keep(api.load(spark, a.store), a.runs, a.peptides, a.peptide_qvalue, a.ms2_qvalue, not a.no_decoys, a.protein_qvalue, a.gene_qvalue), a.out)
    elif a.command == "backpropagate":
        from quantloom.operators.files import backpropagate

        own, merged = api.load(spark, a.store), api.load(spark, a.merged)
        api.save({n: backpropagate(own["feature"], merged[n]) for n in ("score_peptide", "score_protein") if n in merged}, a.out)
    else:
        rows = api.statistics(api.load(spark, a.store)).orderBy("run_id")
        print("\t".join(rows.columns))
        for r in rows.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in r))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("quantloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
