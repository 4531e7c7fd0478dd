"""Command line: `python -m readmill TOOL ACTION -s FILE ...`, one operator on one or two files.

Options have the letters and defaults that users of such tools know; results go to folders beside the source, named
after it with a label.
"""

from __future__ import annotations

import argparse
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill import result
from readmill.functions import annotation as A
from readmill.functions import headers as H
from readmill.operators import alignment, assembly, clustering, collapse, consensus, errors, filters, pairing, primers, split, unify
from readmill.sources import sequence_files as IO

FORMATS = {"generic": H.generic, "454": H.roche454, "genbank": H.genbank, "illumina": H.illumina, "imgt": H.imgt, "sra": H.sra, "migec": H.migec}


class Run:
    """A call's session, options and files."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace) -> None:
        self.spark, self.args = spark, args

    def read(self, path: str) -> DataFrame:
        return IO.read_sequences(self.spark, path, delimiters=self.args.delim)

    def write(self, out: DataFrame, source: str, label: str, by: str | None = None) -> str:
        a, kind = self.args, "fasta" if self.args.fasta else IO.file_kind(source)
        path = a.o if a.o and not label.endswith("-fail") else IO.output_path(source, label, kind, a.outdir, a.outname, a.gzip_output)
        IO.write_sequences(out, path, kind, a.gzip_output, by, a.delim)
        return path

    def table(self, out: DataFrame, source: str, label: str, null: str = "") -> str:
        path = IO.output_path(source, label, "tab", self.args.outdir, self.args.outname)
        IO.write_table(out, path, null)
        return path

    def fails(self, out: DataFrame, source: str, label: str) -> list[str]:
        """What failed, if asked for."""
        return [self.write(out, source, f"{label}-fail")] if self.args.failed else []

    def logged(self, rows: DataFrame) -> None:
        """A log of an operator's rows, if asked for."""
        if self.args.log:
            IO.write_log(rows, self.args.log)

    def logged_sets(self, rows: DataFrame, by: str, **columns: Column) -> None:
        """A log of a row a set: its name, its number of reads, and the given sums, if asked for."""
        self.logged(rows.groupBy(F.col(by).cast("string").alias("ID")).agg(F.count("*").alias("READS"), *(c.alias(k) for k, c in columns.items())))

    def both(self, out: DataFrame, reads: DataFrame, source: str, label: str, *columns: str) -> list[str]:
        """What passed, and what failed and the log if asked for."""
        self.logged(result.log(out, *columns))
        return [self.write(result.passed(out), source, f"{label}-pass"), *self.fails(result.failed(out, reads), source, label)]


def filter_reads(run: Run) -> list[str]:
    a, steps = run.args, {
        "length": lambda r: filters.length(r, a.n if a.n is not None else 250, a.inner), "missing": lambda r: filters.missing(r, a.n if a.n is not None else 10, a.inner),
        "repeats": lambda r: filters.repeats(r, a.n if a.n is not None else 15, a.missing, a.inner), "quality": lambda r: filters.quality(r, a.q, a.inner),
        "trimqual": lambda r: filters.trim_quality(r, a.q, a.win, a.reverse), "maskqual": lambda r: filters.mask_quality(r, a.q),
    }
    reads = run.read(a.s)
    return run.both(steps[a.action](reads), reads, a.s, a.action)


def mask_primers(run: Run) -> list[str]:
    a, reads = run.args, run.read(run.args.s)
    if a.action == "extract":
        hit = primers.extract_region(reads, a.start, a.len, a.revpr)
    else:
        known = IO.read_primers(run.spark, a.p)
        known = primers.reverse_primers(known) if a.revpr else known
        hit = primers.score_primers(reads, known, a.start, a.maxerror, a.revpr) if a.action == "score" else primers.align_primers(reads, known, a.maxerror, a.maxlen, a.revpr, a.skiprc, tuple(a.gap))
    out = primers.mask(hit, a.mode, a.barcode, a.barcodelen, a.revpr, a.bf, a.pf, a.action == "align")
    return run.both(out, reads, a.s, "primers", "primer", "error", "p_start", "p_end")


def pair_reads(run: Run) -> list[str]:
    a = run.args
    one, two = run.read(a.s1), run.read(a.s2)
    out = pairing.pair(one, two, a.fields1, a.fields2, a.act and a.act[0], a.coord)
    names = F.element_at(F.split("header", f"\\{a.delim[0]}"), 1)
    done = [run.write(out.select(f"r{k}.*").withColumn("read_id", names), path, "pair-pass") for k, path in ((1, a.s1), (2, a.s2))]
    alone = pairing.unpaired(one, two, a.coord)
    for k, path in ((1, a.s1), (2, a.s2)):
        done += run.fails(alone.where(F.col("side") == k), path, "pair")
    return done


def assemble(run: Run) -> list[str]:
    a = run.args
    one, two = run.read(a.s1), run.read(a.s2)
    pairs = pairing.pair(one, two, kind=a.coord)
    mates = assembly.oriented(pairs, a.rc)
    refs = IO.read_references(run.spark, a.r) if a.r else None
    out = {
        "join": lambda: assembly.join(mates, a.gap[0]), "align": lambda: assembly.align(mates, a.alpha, a.maxerror, a.minlen, a.maxlen, a.scanrev),
        "reference": lambda: assembly.reference(mates, refs, a.minident, a.evalue, a.maxhits, a.fill),
        "sequential": lambda: assembly.sequential(mates, refs, alpha=a.alpha, most_error=a.maxerror, least=a.minlen, most=a.maxlen, scan_reverse=a.scanrev, least_ident=a.minident, evalue=a.evalue, most_hits=a.maxhits, fill=a.fill),
    }[a.action]()
    done = assembly.assembled_reads(pairs, out.where("valid"), a.fields1, a.fields2).withColumnRenamed("coord", "read_id")
    run.logged(out.select(F.col("coord").alias("ID"), F.col("valid").alias("PASS"), F.length("seq").alias("LENGTH")))
    paths, good = [run.write(done, a.s1, "assemble-pass")], out.where("valid").select("coord")
    for reads, path in ((one, a.s1), (two, a.s2)):
        paths += run.fails(pairing.keyed(reads, a.coord).join(good, "coord", "left_anti"), path, "assemble")
    return paths


def build_consensus(run: Run) -> list[str]:
    a = run.args
    reads = run.read(a.s)
    out = consensus.build(reads, a.bf, a.n or 1, a.q, a.freq, a.maxgap, a.pf, a.prcons, a.cf, a.act, a.dep, a.maxdiv, a.maxerror, IO.file_kind(a.s) == "fastq")
    run.logged(out.select(F.col("set_id").alias("BARCODE"), F.col("conscount").alias("CONSCOUNT"), F.length("seq").alias("LENGTH")))
    rest = consensus.with_set(reads, a.bf).join(out.select("set_id"), "set_id", "left_anti")
    return [run.write(out.withColumnRenamed("set_id", "read_id"), a.s, "consensus-pass"), *run.fails(rest, a.s, "consensus")]


def collapse_reads(run: Run) -> list[str]:
    a, reads = run.args, run.read(run.args.s)
    options = dict(uniq_fields=a.uf, copy_fields=a.cf, copy_actions=a.act, max_field=a.maxf, min_field=a.minf, inner=a.inner)
    out = collapse.ambiguous_reads(reads, a.n, **options) if a.n else collapse.unique_reads(reads, **options)
    if a.keepmiss:
        out = out.unionByName(collapse.undetermined(reads, a.n or 0, a.inner).select(out.columns))
    run.logged(out.select(F.col("read_id").alias("ID"), F.col("dupcount").alias("DUPCOUNT")))
    unclear = collapse.undetermined(reads, a.n or 0, a.inner)
    paths = [run.write(out, a.s, "collapse-unique")]
    if a.failed:
        twice = collapse.duplicates(reads.join(unclear.select("ord"), "ord", "left_anti"), out)
        paths += [run.write(twice, a.s, "collapse-duplicate"), run.write(unclear, a.s, "collapse-undetermined")]
    return paths


def align_sets(run: Run) -> list[str]:
    a = run.args
    if a.action == "table":
        rows = alignment.offset_table(IO.read_primers(run.spark, a.p), a.reverse)
        return [run.table(run.spark.createDataFrame(rows, "primer string, offset int"), a.p, "offsets-" + ("reverse" if a.reverse else "forward"))]
    reads = run.read(a.s)
    sets = consensus.with_set(reads, a.bf)
    out = alignment.multiple_align(sets) if a.action == "multiple" else alignment.offset_align(sets, IO.read_offsets(run.spark, a.d), a.pf or "PRIMER", a.mode)
    if a.div:
        spread = consensus.diversity(out).withColumn("v", A.number_text(F.round("diversity", 6)))
        out = out.join(spread.select("set_id", "v"), "set_id").withColumn("ann", A.add(F.col("ann"), {"DIVERSITY": F.col("v")})).drop("v")
    run.logged_sets(out, "set_id", LENGTH=F.max(F.length("seq")))
    return [run.write(out, a.s, "align-pass"), *run.fails(result.missing(out, reads), a.s, "align")]


def cluster(run: Run) -> list[str]:
    a, reads = run.args, run.read(run.args.s)
    more = dict(ident=a.ident, length_ratio=a.length, cluster_field=a.k or "CLUSTER", prefix=a.prefix)
    out = {"set": lambda: clustering.cluster_sets(reads, a.f[0], start=a.start, end=a.end, **more), "all": lambda: clustering.cluster_all(reads, start=a.start, end=a.end, **more), "barcode": lambda: clustering.cluster_barcodes(reads, a.f[0], **more)}[a.action]()
    run.logged_sets(out, "set_id" if a.action == "set" else "cluster", CLUSTERS=F.count_distinct("cluster"))
    return [run.write(out, a.s, "cluster-pass"), *run.fails(result.missing(out, reads), a.s, "cluster")]


def estimate_error(run: Run) -> list[str]:
    a, reads = run.args, run.read(run.args.s)
    def threshold(at: float) -> DataFrame:
        return run.spark.createDataFrame([("ALL", at)], "TYPE string, THRESHOLD double")

    if a.action == "barcode":
        found = errors.barcode_distances(reads, a.f[0], a.pad)
        sets = consensus.with_set(reads, a.f[0])
        run.logged_sets(sets, "set_id")
        tables = [run.table(found, a.s, "distance-barcode"), run.table(threshold(errors.distance_threshold(found)), a.s, "threshold-barcode")]
        return [*tables, *run.fails(result.missing(sets, reads), a.s, "error")]
    sets = errors.usable_sets(reads, a.f[0], a.n or 20, a.maxdiv)
    plain = sets.drop("set_n")
    found = consensus.frequency_sets(plain, a.freq) if a.mode == "freq" else consensus.quality_sets(plain, a.q, a.freq)
    letters = errors.compared(sets, found)
    tables = {"position": errors.error_table(letters, "pos"), "quality": errors.error_table(letters, "q"), "set": errors.error_table(letters, "set_n"), "nucleotide": errors.nucleotide_table(letters), "distance-set": errors.set_distances(sets)}
    paths = [run.table(t, a.s, f"error-{k}", "NA") for k, t in tables.items()]
    run.logged_sets(sets, "set_id")
    paths.append(run.table(threshold(errors.set_threshold(tables["distance-set"])), a.s, "threshold-set"))
    return [*paths, *run.fails(result.missing(sets, reads), a.s, "error")]


def parse_headers(run: Run) -> list[str]:
    a, reads = run.args, run.read(run.args.s)
    if a.action == "table":
        columns = [F.col("read_id").alias("ID") if f.upper() == "ID" else F.coalesce(A.get(F.col("ann"), f), F.lit("")).alias(f.upper()) for f in a.f]
        return [run.table(reads.select(*columns), a.s, "headers")]
    ann, act = F.col("ann"), a.act and a.act[0]
    new = {
        "add": lambda: A.add(ann, dict(zip(a.f, map(F.lit, a.u), strict=True))), "collapse": lambda: A.collapse(ann, act, a.f), "copy": lambda: A.copy(ann, a.f, a.k_list, a.act),
        "delete": lambda: A.delete(ann, a.f), "expand": lambda: A.expand(ann, a.f, a.sep), "merge": lambda: A.merge_fields(ann, a.f, a.k_list[0], act, a.delete), "rename": lambda: A.rename(ann, a.f, a.k_list, a.act),
    }[a.action]()
    # a read without any of the fields that are to be changed is as it was, and counts as failed
    known = F.lit(True) if a.action == "add" else reduce(lambda x, y: x | y, (A.has(ann, f) for f in a.f))
    run.logged(reads.select(F.col("read_id").alias("ID"), known.alias("PASS")))
    return [run.write(reads.withColumn("ann", new), a.s, "reheader"), *run.fails(reads.where(~known), a.s, "reheader")]


def convert_headers(run: Run) -> list[str]:
    a = run.args
    make = (lambda h: H.imgt(h, simple=True)) if a.simple and a.action == "imgt" else FORMATS[a.action]
    kind = IO.read_fasta if IO.file_kind(a.s) == "fasta" else IO.read_fastq
    reads = kind(run.spark, a.s, parse=False).withColumn("h", make(F.col("header")))
    good = reads.where("h is not null").withColumns({"read_id": F.col("h.read_id"), "ann": F.col("h.ann")})
    return [run.write(good, a.s, "convert-pass"), *run.fails(reads.where("h is null").withColumn("read_id", F.col("header")), a.s, "convert")]


def split_reads(run: Run) -> list[str]:
    a = run.args
    if a.action == "samplepair":
        out = split.sample_pairs(run.read(a.s1), run.read(a.s2), a.n, a.f and a.f[0], a.coord)
        return [run.write(x, path, f"sample-n{a.n}") for x, path in zip(out, (a.s1, a.s2), strict=True)]
    reads = run.read(a.s)
    field = a.f and a.f[0]
    if a.action in ("count", "group") or a.action == "sort" and a.n:
        out = split.by_count(reads, a.n) if a.action == "count" else split.by_group(reads, field, a.num_value) if a.action == "group" else split.sorted_parts(reads, field, a.n, a.num)
        return [run.write(out, a.s, {"count": "part", "group": field, "sort": "sorted"}[a.action], by="part")]
    out = {"sample": lambda: split.sample(reads, a.n, field, a.u), "select": lambda: split.select(reads, field, IO.read_values(run.spark, a.t, field) if a.t else a.u, a.invert), "sort": lambda: split.sort(reads, field, a.num)}[a.action]()
    return [run.write(out, a.s, {"sample": f"sample-n{a.n}", "select": "selected", "sort": "sorted"}[a.action])]


def unify_headers(run: Run) -> list[str]:
    a = run.args
    reads, field = run.read(a.s), a.k or "SAMPLE"
    out = (unify.consensus if a.action == "consensus" else unify.deletion)(reads, a.f[0], field)
    if a.log:
        found = consensus.majority(consensus.with_set(reads, a.f[0]), field)
        alone = F.lit(True) if a.action == "consensus" else F.size("values") == 1
        texts = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c.upper()) for c in ("values", "counts")]
        run.logged(found.select(F.col("set_id").alias("ID"), alone.alias("PASS"), F.col("n").alias("READS"), *texts))
    return [run.write(out, a.s, "unify-pass"), *run.fails(result.missing(out, reads), a.s, "unify")]


def parse_log(run: Run) -> list[str]:
    return [run.table(IO.read_log(run.spark, run.args.s, run.args.f).drop("ord"), run.args.s, "table")]


TOOLS = {
    "filter": (filter_reads, ["length", "missing", "repeats", "quality", "trimqual", "maskqual"]), "primers": (mask_primers, ["score", "align", "extract"]), "pair": (pair_reads, ["run"]),
    "assemble": (assemble, ["join", "align", "reference", "sequential"]), "consensus": (build_consensus, ["run"]), "collapse": (collapse_reads, ["run"]), "align": (align_sets, ["multiple", "offset", "table"]),
    "cluster": (cluster, ["set", "all", "barcode"]), "error": (estimate_error, ["set", "barcode"]), "headers": (parse_headers, ["add", "collapse", "copy", "delete", "expand", "merge", "rename", "table"]),
    "convert": (convert_headers, list(FORMATS)), "split": (split_reads, ["count", "group", "sample", "samplepair", "select", "sort"]), "unify": (unify_headers, ["consensus", "delete"]), "log": (parse_log, ["run"]),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("readmill")
    out.add_argument("tool", choices=TOOLS)
    out.add_argument("action", help="what the tool does; `run` for tools that do one thing")
    text = {"-s": "s", "-1": "s1", "-2": "s2", "-p": "p", "-r": "r", "-d": "d", "-t": "t", "-k": "k", "--outdir": "outdir", "--outname": "outname", "--pf": "pf", "--maxf": "maxf", "--minf": "minf", "--prefix": "prefix", "-o": "o", "--log": "log"}
    for flag, dest in text.items():
        out.add_argument(flag, dest=dest, default="" if dest == "prefix" else None)
    for flag, dest in {"-f": "f", "-u": "u", "--1f": "fields1", "--2f": "fields2", "--act": "act", "--cf": "cf", "--uf": "uf", "--names": "k_list"}.items():
        out.add_argument(flag, dest=dest, nargs="+")
    for flag, kind, default in (
        ("-n", int, None), ("-q", int, None), ("--win", int, 10), ("--start", int, 0), ("--end", int, None), ("--len", int, 0), ("--maxerror", float, None), ("--maxlen", int, None), ("--barcodelen", int, None), ("--freq", float, 0.6),
        ("--maxgap", float, None), ("--prcons", float, None), ("--maxdiv", float, None), ("--alpha", float, 1e-5), ("--minlen", int, 8), ("--minident", float, 0.5), ("--evalue", float, 1e-5), ("--maxhits", int, 100),
        ("--ident", float, 0.9), ("--length", float, 0.0), ("--num-value", float, None), ("--bf", str, "BARCODE"), ("--mode", str, None), ("--coord", str, "annotated"), ("--rc", str, "tail"), ("--pad", str, "none"), ("--sep", str, ","),
    ):
        out.add_argument(flag, type=kind, default=default)
    out.add_argument("--delim", nargs=3, default=list(A.DELIMITERS))
    out.add_argument("--gap", type=int, nargs="+", default=None)
    for flag in ("--inner", "--missing", "--reverse", "--revpr", "--skiprc", "--barcode", "--dep", "--fill", "--scanrev", "--keepmiss", "--delete", "--simple", "--num", "--failed", "--fasta", "--gzip-output", "--div"):
        out.add_argument(flag, action="store_true")
    out.add_argument("--not", dest="invert", action="store_true")
    return out


def defaults(a: argparse.Namespace) -> argparse.Namespace:
    """What depends on the tool."""
    given = lambda name, value: setattr(a, name, value) if getattr(a, name) is None else None
    given("q", 20 if a.tool == "filter" else 0)
    if a.tool != "consensus":
        given("maxerror", 0.3 if a.tool == "assemble" else 0.2)
    given("maxlen", 1000 if a.tool == "assemble" else 50)
    given("mode", {"primers": "mask", "align": "pad"}.get(a.tool, "freq"))
    given("gap", [0] if a.tool == "assemble" else [1, 1])
    if a.tool == "primers":
        given("pf", "PRIMER")
    if a.tool in ("cluster", "error", "unify"):
        given("f", ["BARCODE"])
    return a


#: Options that a tool's action can't do without.
NEEDED = {
    "filter": ["s"], "primers": ["s"], "pair": ["s1", "s2"], "assemble": ["s1", "s2"], "consensus": ["s"], "collapse": ["s"], "cluster": ["s"], "error": ["s"], "headers": ["s", "f"], "convert": ["s"],
    "unify": ["s"], "log": ["s", "f"], "align multiple": ["s"], "align offset": ["s", "d"], "align table": ["p"], "primers score": ["p"], "primers align": ["p"], "primers extract": ["len"],
    "assemble reference": ["r"], "assemble sequential": ["r"], "headers add": ["u"], "headers copy": ["k_list"], "headers merge": ["k_list"], "headers rename": ["k_list"], "headers collapse": ["act"],
    "split count": ["s", "n"], "split group": ["s", "f"], "split sample": ["s", "n"], "split samplepair": ["s1", "s2", "n"], "split select": ["s", "f"], "split sort": ["s", "f"],
}
FLAGS = {"s1": "-1", "s2": "-2", "k_list": "--names", "act": "--act", "len": "--len"}


def check(p: argparse.ArgumentParser, a: argparse.Namespace) -> None:
    """Errors of options that don't fit together, before anything is read."""
    for name in [*NEEDED.get(a.tool, []), *NEEDED.get(f"{a.tool} {a.action}", [])]:
        if not getattr(a, name):
            p.error(f"{a.tool} {a.action} needs {FLAGS.get(name, '-' + name)}")
    for name in ("s", "s1", "s2", "p", "r", "d", "t"):
        at = getattr(a, name)
        if at and "://" not in at and not os.path.exists(at):
            p.error(f"{at} does not exist")
    for name in ("s", "s1", "s2"):
        if (at := getattr(a, name)) and a.tool != "log" and IO.file_kind(at) not in ("fasta", "fastq"):
            p.error(f"{at} is neither FASTA nor FASTQ")
    if len(set(a.delim)) < 3 or any(len(d) != 1 for d in a.delim):
        p.error("--delim takes three different characters")
    same = [("cf", "act")] if a.tool in ("consensus", "collapse") else [("f", {"add": "u", "copy": "k_list", "rename": "k_list"}.get(a.action, "f"))] if a.tool == "headers" else []
    for one, two in same:
        if len(getattr(a, one) or []) != len(getattr(a, two) or []):
            p.error(f"as many values are needed for {FLAGS.get(two, '-' + two)} as for -{one}")
    if a.tool == "consensus" and a.maxdiv is not None and a.maxerror is not None:
        p.error("give --maxdiv or --maxerror, not both")
    if a.prcons is not None and not a.pf:
        p.error("--prcons needs --pf")
    if a.maxf and a.minf:
        p.error("give --maxf or --minf, not both")
    if a.o and (a.outname or a.tool in ("pair", "error") or a.action == "samplepair"):
        p.error("-o names one output: it goes neither with --outname nor with tools of several outputs")
    for name, low, high in (("maxerror", 0, 1), ("freq", 0, 1), ("maxgap", 0, 1), ("maxdiv", 0, 1), ("prcons", 0, 1), ("ident", 0, 1), ("minident", 0, 1), ("alpha", 0, 1)):
        if (x := getattr(a, name)) is not None and not low <= x <= high:
            p.error(f"--{name} is between {low} and {high}")
    for name in ("start", "len", "minlen", "win"):
        if getattr(a, name) < 0:
            p.error(f"--{name} can't be negative")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    p = parser()
    a = defaults(p.parse_args(argv))
    run, actions = TOOLS[a.tool]
    if a.action not in actions:
        p.error(f"{a.tool} has the actions {', '.join(actions)}")
    a.delim = tuple(a.delim)
    check(p, a)
    if a.outdir:
        os.makedirs(a.outdir, exist_ok=True)
    return run(Run(spark or SparkSession.builder.appName(f"readmill {a.tool}").getOrCreate(), a))


if __name__ == "__main__":
    print("\n".join(main()))
