"""python -m tidemark COMMAND: inspect, validate, search, search-text, search-ann, benchmark, stats, cite, measure, gates, fingerprint."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .acceptance import measure_presets, metrics_json, read_metrics
from .corpus import Corpus
from .errors import CorpusError
from .identity import fingerprint, resolve_model_folder
from .operators.evaluate import check_gates
from .operators.search import parse_vector


def _vector(spark: SparkSession, literal: str) -> list[float]:
    got = spark.range(1).select(parse_vector(F.lit(literal)).alias("v")).first().v
    if got is None:
        raise CorpusError(f"not a JSON array of numbers: {literal}")
    return got


def process_embedder(program: str, model: str, model_path: str | None = None):
    """An embedder that runs a program with the model and the text and reads its JSON answer."""

    def run(text: str) -> dict[str, Any]:
        args = [sys.executable, program, *(["--model-path", model_path] if model_path else []), model, text]
        done = subprocess.run(args, capture_output=True, text=True)
        if done.returncode:
            raise CorpusError(f"the embedder failed: {done.stderr.strip()}")
        try:
            return json.loads(done.stdout)
        except ValueError as e:
            raise CorpusError(f"the embedder's answer is not JSON: {e}") from e

    return run


def _print(hits: DataFrame) -> None:
    for r in hits.orderBy("query_id", "rank").collect():
        print(f"{r.rank:>3}  {r.score:.6f}  {r.source_uri}:{r.offset_start}-{r.offset_end}  {r.citation_id}")


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *more: str):
        p = commands.add_parser(name)
        for a in ("corpus", *more):
            p.add_argument(a)
        return p

    add("inspect").add_argument("--json", action="store_true")
    add("validate")
    add("stats")
    add("cite", "citation")
    for name in ("search", "search-ann", "search-text"):
        p = add(name, "query")
        p.add_argument("-k", type=int, default=10)
        if name == "search-ann":
            p.add_argument("--ef", type=int, default=100)
        if name == "search-text":
            p.add_argument("--embedder", required=True)
            p.add_argument("--candidates", type=int)
            p.add_argument("--model-path")
            p.add_argument("--skip-model-hash-check", action="store_true")
    p = add("benchmark")
    p.add_argument("-q", "--queries", type=int, default=100)
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--ann", type=int)
    p.add_argument("--cold", action="store_true")
    p = add("measure", "folder")
    p.add_argument("--json", help="where the measures go; standard output without it")
    p.add_argument("-q", "--queries", type=int, default=50)
    p.add_argument("-k", type=int, default=10)
    p = commands.add_parser("gates")
    p.add_argument("baseline")
    p.add_argument("measured")
    p = commands.add_parser("fingerprint")
    p.add_argument("model")
    p.add_argument("--model-id")
    return top


def _gates(spark: SparkSession, baseline: str, measured: str) -> int:
    """Print each gate; 1 if one fails."""
    texts = []
    for path in (baseline, measured):
        with open(path, encoding="utf-8") as f:
            texts.append(read_metrics(spark, f.read()))
    rows = check_gates(*texts).orderBy("preset", "measure").collect()
    for r in rows:
        print(f"{'ok  ' if r.passed else 'FAIL'} {r.preset} {r.measure}: {r.value} (bound {r.bound})")
    return int(not all(r.passed for r in rows))


def run(spark: SparkSession, argv: list[str]) -> int:
    a = _arguments().parse_args(argv)
    try:
        if a.command == "gates":
            return _gates(spark, a.baseline, a.measured)
        if a.command == "fingerprint":
            found = fingerprint(resolve_model_folder(a.model), a.model_id)
            print(json.dumps(asdict(found) | {"model_hash": found.model_hash()}, sort_keys=True))
            return 0
        c = Corpus.open(spark, a.corpus)
        if a.command == "inspect":
            doc = c.inspect()
            print(json.dumps(doc) if a.json else "\n".join(f"{k}: {json.dumps(v)}" for k, v in doc.items()))
        elif a.command == "validate":
            wrong = c.validate().limit(20).collect()
            for r in wrong:
                print(f"row {r.row_id}: {r.rule}")
            print("unsound" if wrong else "ok")
            return int(bool(wrong))
        elif a.command == "stats":
            for r in c.stats().collect():
                print(f"{r['name']}: {r['value']}")
        elif a.command == "cite":
            for k, v in c.cite(a.citation).items():
                print(f"{k}: {v}")
        elif a.command == "search":
            _print(c.search(_vector(spark, a.query), a.k))
        elif a.command == "search-ann":
            _print(c.search_ann(_vector(spark, a.query), a.k, a.ef))
        elif a.command == "search-text":
            embedder = process_embedder(a.embedder, c.manifest.embedding_model, a.model_path)
            _print(c.search_text(a.query, embedder, a.k, a.candidates, a.skip_model_hash_check))
        elif a.command == "measure":
            text = metrics_json(measure_presets(c, a.folder, a.queries, a.k))
            if a.json:
                with open(a.json, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                print(text, end="")
        else:
            for line in c.benchmark(a.queries, a.k, a.ann, a.cold):
                print(json.dumps(line))
    except (CorpusError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def main() -> None:
    spark = SparkSession.builder.appName("tidemark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))
