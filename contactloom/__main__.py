"""Command line: python -m contactloom [options] COMMAND ...

    compare | ari     CHROMOSOMES OUT BED BED [BED ...]     agreement of every pair of annotations
    shuffle           CONTACTS BED,BED OUTFOLDER NAME,NAME  block scores: a report and tables
    cvs               CONTACTS OUTFOLDER BED,BED NAME,NAME  coefficients of variation
    direct-slice      CONTACTS BED OUTFOLDER                compressed matrix of an annotation and its similarities
    slice             CONTACTS FIRST,PAST OUTFOLDER         annotations with FIRST to PAST - 1 clusters

A command is known by its beginning, in any case: `comparePerChrom`, `ARI` or `shuffle-scores` do.
CONTACTS is a raw contact file, a folder of them, or a Parquet table; CHROMOSOMES a file of names and lengths.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import commands
from .sources import bed, exports, raw_contacts, tables

VERSION = "0.3"
#: Exit codes of wrong arguments, by command.
WRONG = {"slice": 5, "direct": 7, "compare": 51, "shuffle": 51, "cvs": 51}


def numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="contactloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-r", "--resolutions", type=numbers, help="bin width; of several the first is taken")
    p.add_argument("-k", "--normalization", default="", help="name of the counts' normalisation, or two names: within and between chromosomes")
    p.add_argument("-w", "--window", type=int, help="bins of a block (shuffle)")
    p.add_argument("--seed", type=numbers, default=[22871], help="of several the last is taken")
    p.add_argument("--genome", help="file of chromosome names and lengths, instead of those of the contact file")
    p.add_argument("--norms", help="Parquet table of normalisation vectors")
    p.add_argument("--eig", action="store_true", help="eigenvector tracks, too (slice)")
    p.add_argument("--restarts", type=int, help="restarts of a clustering (slice)")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-V", "--version", action="version", version=VERSION)
    p.add_argument("command")
    p.add_argument("arguments", nargs="*")
    return p


def command_of(text: str) -> str | None:
    """The command that a word begins with."""
    word = text.lower()
    if word.startswith("direct") and "slice" in word:
        return "direct"
    if word.startswith("ari"):
        return "compare"
    return next((c for c in ("slice", "compare", "shuffle", "cvs") if word.startswith(c)), None)


class Job:
    """What the commands share: options, contacts, chromosomes."""

    def __init__(self, spark: SparkSession, options: argparse.Namespace, contacts: str | None = None, chromosomes: str | None = None):
        self.spark, self.options = spark, options
        self.resolution = options.resolutions[0] if options.resolutions else 100_000
        self.seed, self.norms = options.seed[-1], [n for n in options.normalization.split(",") if n and n.upper() != "NONE"]
        raw = False
        if contacts is not None:
            raw = raw_contacts.is_raw(contacts)
            table = (raw_contacts if raw else tables).contacts(spark, contacts)
            self.raw = table.where(F.col("resolution") == self.resolution)
        listed = options.genome or chromosomes
        if listed is None and not raw:
            raise SystemExit("a table of contacts does not name its chromosomes: give --genome")
        self.chroms = tables.chromosomes(spark, listed) if listed else raw_contacts.chromosomes(spark, contacts)

    def vector(self, name: str) -> DataFrame:
        if not self.options.norms:
            raise SystemExit("normalised counts need their vectors: give --norms")
        return tables.norm_vector(self.spark.read.parquet(self.options.norms), name, self.resolution)

    def counts(self) -> DataFrame:
        """Raw counts, or those normalised by the given name (the one between chromosomes, of two)."""
        return tables.normalised(self.raw, self.vector(self.norms[-1])) if self.norms else self.raw

    def tracks(self, paths: list[str], names: list[str]) -> DataFrame:
        return bed.read_many(self.spark, dict(zip(names, paths, strict=True)), self.chroms, self.resolution)


def compare(job: Job, word: str, out: str, files: list[str]) -> None:
    rows = commands.compare(job.tracks(files, files), word.lower().startswith("ari"))
    rows.write.mode("overwrite").parquet(out)


def shuffle(job: Job, files: str, out: str, names: str) -> None:
    many = job.tracks(files.split(","), names.split(","))
    window = job.options.window if job.options.window and job.options.window > 1 else None
    scores, means = commands.block_scores(job.counts(), many, job.chroms, job.resolution, compression=window, seed=job.seed)
    scores.write.mode("overwrite").parquet(f"{out}/scores")
    scores = job.spark.read.parquet(f"{out}/scores")
    means.write.mode("overwrite").parquet(f"{out}/means")
    means = job.spark.read.parquet(f"{out}/means")
    for name in names.split(","):
        report = exports.score_report(*(f.where(F.col("track_id") == name) for f in (scores, means)))
        job.spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report_{name}")
        print(f"{name}\n{report}")


def cvs(job: Job, out: str, files: str, names: str) -> None:
    files, names = files.split(","), names.split(",")
    if len(files) != len(names):
        print("number of bed files should match number of names", file=sys.stderr)
        raise SystemExit(53)
    many = job.tracks(files, names)
    same = commands.tracks.common_loci(many, job.resolution, len(names))
    for name in names:
        rows, spread = commands.cvs(job.counts(), same.where(F.col("track_id") == name).drop("track_id"), job.resolution)
        rows.write.mode("overwrite").parquet(f"{out}/{name}")
        spread.write.mode("overwrite").parquet(f"{out}/{name}_deviation")


def direct(job: Job, file: str, out: str) -> None:
    track = job.tracks([file], [file]).drop("track_id")
    n = track.select("cluster_id").distinct().count() * job.chroms.count()
    commands.compress(job.raw, track, job.resolution, n).write.mode("overwrite").parquet(out)


def slice_(job: Job, groups: str, out: str) -> None:
    first, past = numbers(groups)
    intra, inter = (job.norms * 2)[:2] if job.norms else (None, None)
    normed = None
    if inter not in (None, "VC"):
        within, between = (tables.normalised(job.raw, job.vector(n)) for n in (intra, inter))
        normed = within.where("chr1 = chr2").unionByName(between.where("chr1 <> chr2"))
    options = {"restarts": job.options.restarts} if job.options.restarts else {}
    parts = job.raw, job.vector("VC"), job.chroms, job.resolution
    best = commands.annotate(*parts, first, past, normed=normed, seed=job.seed, **options)
    for k in range(first, past):
        one = best.where(F.col("k") == k).withColumn("cluster_name", F.concat(F.lit("C"), "cluster_id"))
        bed.bed9(one, job.chroms).coalesce(1).write.mode("overwrite").text(f"{out}/k{k}")
    if job.options.eig:
        for name, track in commands.eigen_tracks(*parts, normed=normed):
            bed.bed_graph(track, job.chroms).coalesce(1).write.mode("overwrite").text(f"{out}/eigen_{name}")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    command, args = command_of(a.command), a.arguments
    if command is None:
        parser().print_usage()
        raise SystemExit(12)
    if len(args) < 4 if command == "compare" else len(args) != {"shuffle": 4, "cvs": 4}.get(command, 3):
        print(__doc__)
        raise SystemExit(WRONG[command])
    spark = SparkSession.builder.appName("contactloom").getOrCreate()
    if command == "compare":
        compare(Job(spark, a, chromosomes=args[0]), a.command, args[1], args[2:])
    else:
        {"shuffle": shuffle, "cvs": cvs, "direct": direct, "slice": slice_}[command](Job(spark, a, args[0]), *args[1:])


if __name__ == "__main__":
    main()
