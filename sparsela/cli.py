"""Command line: ``python -m sparsela.cli`` train, train-patches, encode, encode-stream, reconstruct."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions.penalties import L1
from .operators.encode import decode, encode, heuristic_lambda
from .operators.learn import DictionaryLearner
from .operators.preprocess import sample_patches, zero_phase_whiten
from .plans.config import training_metadata
from .session import ship
from .sources.tables import load_model, save_model
from .streaming.online import encode_stream


def _learner(a) -> DictionaryLearner:
    return DictionaryLearner(n_atoms=a.atoms, n_steps=a.steps, lam=a.lam if a.lam is not None else "auto", seed=a.seed)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparsela")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("train", "train-patches"):
        s = sub.add_parser(name)
        s.add_argument("input", help="Parquet: image_id, pix (train) or sample_id, x (train-patches)")
        s.add_argument("model")
        s.add_argument("--atoms", type=int, default=144)
        s.add_argument("--steps", type=int, default=50)
        s.add_argument("--lam", type=float)
        s.add_argument("--seed", type=int, default=0)
        s.add_argument("--patch", type=int, default=16)
        s.add_argument("--patches", type=int, default=50_000)
        s.add_argument("--f0", type=float, default=200.0)
    for name in ("encode", "encode-stream", "reconstruct"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("model")
        s.add_argument("output")
        s.add_argument("--lam", type=float)
        s.add_argument("--checkpoint")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("sparsela").getOrCreate()
    ship(spark)
    if a.command == "train":
        img = spark.read.parquet(a.input)
        df = None
        for h, w in sorted(tuple(r) for r in img.select(F.size("pix"), F.size(F.element_at("pix", 1))).distinct().collect()):  # images of each size apart
            own = img.where((F.size("pix") == h) & (F.size(F.element_at("pix", 1)) == w))
            flat = zero_phase_whiten(own.select("image_id", F.flatten("pix").alias("x")), (h, w), a.f0)
            part = flat.select("image_id", A.reshape("x", w).alias("pix"))
            df = part if df is None else df.unionAll(part)
        df = sample_patches(df, a.patch, a.patch, a.patches, a.seed)
        df = df.select(F.xxhash64("image_id", "i", "j").alias("sample_id"), "x")
    elif a.command == "train-patches":
        df = spark.read.parquet(a.input).withColumn("x", A.center(A.doubles("x")))
    if a.command.startswith("train"):
        model = _learner(a).fit(df)
        save_model(spark, model.atoms, a.model, training_metadata(model))
        return 0
    d, _ = load_model(spark, a.model)
    if a.command == "reconstruct":
        decode(spark.read.parquet(a.input), d).select("sample_id", "x_hat").write.parquet(a.output)
    elif a.command == "encode":
        df = spark.read.parquet(a.input)
        lam = a.lam if a.lam is not None else heuristic_lambda(df, "median", atoms=d)
        encode(df, d, L1(lam)).write.parquet(a.output)
    else:
        stream = spark.readStream.schema("sample_id long, x array<double>").parquet(a.input)
        encode_stream(stream, d, L1(0.1 if a.lam is None else a.lam), a.output, a.checkpoint or f"{a.output}/_checkpoint").awaitTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
