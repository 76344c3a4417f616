"""Compile commands as arrays of arguments: parsing, rewriting, sweeps, removal and reordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Options that take the next argument; prefixes that are never removed; known modes.
TAKES_NEXT = ("-Xlinker", "-MF", "-MT", "-isystem", "-o", "-D")
PROTECTED = ("-o", "-I", "-L", "-c")
MODES = ("argsremove", "argsreorder", "replace_all", "remove_single", "remove_pair", "remove_parentheses", "replace_colon_with_semicolon", "add_asterisk_to_variables", "lambda_captures", "agent")
CPP_STANDARDS = ("98", "03", "11", "14", "17", "20")
CL_STANDARDS = ("1.0", "1.1", "1.2", "2.0", "2.1", "3.0")


def is_protected(arg: Column) -> Column:
    out = F.lit(False)
    for p in PROTECTED:
        out = out | arg.startswith(p)
    return out


def join_options(argv: Column) -> Column:
    """Arguments after the compiler; an option that takes the next one is joined to it by a blank."""
    step = lambda acc, x: F.when(
        F.element_at(acc, -1).isin(*TAKES_NEXT), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), x)))
    ).otherwise(F.concat(acc, F.array(x)))
    # the first element only keeps the array non-empty
    return F.aggregate(F.slice(argv, F.lit(2), F.greatest(F.size(argv) - 1, F.lit(0))), F.array(F.lit("")), step, lambda acc: F.slice(acc, F.lit(2), F.greatest(F.size(acc) - 1, F.lit(0))))


def parse(argv: Column) -> Column:
    """compiler, source_file, other_params."""
    from .text import has_source_extension

    rest = join_options(argv)
    source = lambda a: has_source_extension(a) & ~a.startswith("-")
    return F.struct(
        F.when(F.element_at(argv, 1).contains("++"), "clang++").otherwise("clang").alias("compiler"),
        F.filter(rest, source).alias("source_file"),
        F.filter(rest, lambda a: ~source(a)).alias("other_params"),
    )


def rewrite(argv: Column) -> Column:
    return F.flatten(
        F.transform(argv, lambda a: F.when(a.contains("clang_cc1"), F.array(F.lit("clang"), F.lit("-cc1"))).when(a.contains("%itanium_abi_triple"), F.array(F.lit("x86_64-unknown-linux-gnu"))).otherwise(F.array(a)))
    )


def sweep(argv: Column, prefix: str = "-std=c++", standards: tuple[str, ...] = CPP_STANDARDS, strip: str | None = None) -> Column:
    """Array of commands, one per standard."""
    kept = F.filter(argv, lambda a: ~a.startswith(strip or prefix))
    return F.transform(F.array(*(F.lit(s) for s in standards)), lambda s: F.concat(kept, F.array(F.concat(F.lit(prefix), s))))


def cl_sweep(argv: Column) -> Column:
    """Array of commands, one per OpenCL standard, without options of an OpenMP version."""
    return sweep(argv, "-cl-std=clc++", CL_STANDARDS, strip="-fopenmp-version")


def substitute(argv: Column, old: Column, new: Column) -> Column:
    """The first argument equal to ``old`` becomes ``new``."""
    at = F.array_position(argv, old)
    return F.transform(argv, lambda a, i: F.when(i + 1 == at, new).otherwise(a))


def assemble(command: Column) -> Column:
    return F.split(F.trim(F.concat_ws(" ", command["compiler"], command["source_file"], command["other_params"])), r"\s+")


def seeded_order(argv: Column, seed: Column) -> Column:
    """Arguments in the order of a digest of seed, place and text: a reproducible shuffle."""
    marked = F.transform(argv, lambda a, i: F.struct(F.md5(F.concat_ws("|", seed.cast("string"), i.cast("string"), a)).alias("k"), a.alias("a")))
    return F.transform(F.array_sort(marked), lambda s: s["a"])


def remove_some(argv: Column, seed: Column, level: int = 1) -> Column:
    """Removes a seeded sample of arguments by value; protected ones stay, so nothing may go.

    Sample sizes by level: 1: one; 2: up to half and one; 3: half up to all but one; else: up to all but one.
    """
    n = F.size(argv)
    half = F.floor(n / 2).cast("int")
    low, high = {1: (F.lit(1), F.lit(1)), 2: (F.lit(1), half + 1), 3: (half, n - 1)}.get(level, (F.lit(1), n - 1))
    draw = F.conv(F.substring(F.md5(seed.cast("string")), 1, 7), 16, 10).cast("int")
    k = F.least(n, F.greatest(F.lit(0), low + draw % F.greatest(high - low + 1, F.lit(1))))
    sample = F.filter(F.slice(seeded_order(argv, seed), F.lit(1), k), lambda a: ~is_protected(a))
    # the sample is bound by a transform over one element, so that it is drawn once, not once for each argument
    return F.flatten(F.transform(F.array(F.struct(argv.alias("argv"), sample.alias("sample"))), lambda x: F.filter(x["argv"], lambda a: ~F.array_contains(x["sample"], a))))


def modes_of_environment(environment: dict[str, str]) -> tuple[list[str], int]:
    """Modes and removal level that FUZZ_MODE and REMOVE_LEVEL ask for; no modes where unset or 'none'."""
    wanted = environment.get("FUZZ_MODE", "").replace(",", " ").replace("&", " ").split()
    return sorted(set(wanted) & set(MODES)), int(environment.get("REMOVE_LEVEL", "1"))


def run_of(argv: list[str], environment: dict[str, str]) -> tuple[list[str], list[str], int]:
    """(command, modes, removal level) of a call in place of a compiler.

    A program that is not named as the wrapper is run as it is; the wrapper stands for clang, or clang++ where its name has two plus signs.
    """
    if "wrapper" not in argv[0]:
        return list(argv), [], 1
    modes, level = modes_of_environment(environment)
    return ["clang++" if "++" in argv[0] else "clang", *argv[1:]], modes, level


def normalise_modes(c: Column) -> Column:
    """Known modes named in a list separated by commas, ampersands or blanks; each once, sorted."""
    named = F.filter(F.split(F.regexp_replace(c, "[,&]", " "), r"\s+"), lambda m: m != "")
    return F.array_sort(F.array_intersect(F.array_distinct(named), F.array(*(F.lit(m) for m in MODES))))
