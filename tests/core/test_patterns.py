"""Growth of patterns: known cases, steps of a backtracking search counted, and a bound on the time over a megabyte."""

import re
import time

import pytest
from gleanery.functions import patterns
from gleanery.operators import rows
from pyspark.sql import functions as F

KNOWN = {
    r"Licensed under [A-Z]+": "linear", r"^[1-3]-": "linear", r"\$\s*([\d,.]+)": "linear", r"(\d{1,3}\.){3}\d{1,3}": "linear", r"(\w{2}){5}": "linear", r"^\w+@\w+": "linear", r"a+": "linear",
    r"\w+@": "polynomial", r"^a*a*$": "polynomial", r".*.*.*=": "polynomial", r"<a[^>]*href": "polynomial", r"(ab|ba)+$": "polynomial", r"(a|ab)+$": "polynomial", r"\s+$": "polynomial",
    r"(a+)+$": "exponential", r"(a|a)+$": "exponential", r"(a|aa)+$": "exponential", r"(?:\d{1,4}\.?)+$": "exponential", r"(\w+){5}$": "exponential", r"(a{1,30}){1,30}b": "exponential",
    r"(a?)+": "exponential", r"(x+x+)+y": "exponential", r"(a?\w)+$": "exponential", r"(?:a{1,3}|b{1,3})+$": "exponential", r"(\s*\w+)*!": "exponential", r"(a?){25}a{25}$": "exponential",
    "(": "invalid", r"(a)\1": "unproven", r"(?=a)b": "unproven",
}


@pytest.mark.parametrize("pattern", KNOWN)
def test_known(pattern):
    assert patterns.growth(pattern)[0] == KNOWN[pattern]


def test_powers():
    assert [patterns.growth(p)[1] for p in (r"^\w+@", r"\w+@", r"\w+@.*=", r".*.*.*=", r"^.*x.*y")] == [1, 2, 2, 4, 2]
    assert patterns.growth("(?:AB|ab)+x", re.IGNORECASE)[0] == "exponential" and patterns.growth("(?:AB|ab)+x")[0] != "exponential"


class Steps:
    """A plain backtracking search over a parsed pattern that counts its steps."""

    def __init__(self, pattern):
        self.tree, self.n = list(re._parser.parse(pattern)), 0

    def search(self, text, most):
        self.n, self.most = 0, most
        try:
            return any(self.seq(self.tree, 0, text, at, lambda i: True) for at in range(len(text) + 1))
        except OverflowError:
            return None

    def seq(self, items, k, text, at, then):
        self.n += 1
        if self.n > self.most:
            raise OverflowError
        if k == len(items):
            return then(at)
        op, arg = items[k]
        name = str(op)
        rest = lambda i: self.seq(items, k + 1, text, i, then)
        if name == "SUBPATTERN":
            return self.seq(list(arg[-1]), 0, text, at, rest)
        if name == "BRANCH":
            return any(self.seq(list(b), 0, text, at, rest) for b in arg[1])
        if name == "MAX_REPEAT":
            low, high, body = arg

            def more(i, count, seen):
                if count < high and (i > seen or count < low) and self.seq(list(body), 0, text, i, lambda j: more(j, count + 1, i)):
                    return True
                return count >= low and rest(i)

            return more(at, 0, -1)
        if name == "AT":
            return (at == 0 if "BEGIN" in str(arg) else at == len(text)) and rest(at)
        one = re._compiler.compile(_single(op, arg), 0)
        return at < len(text) and one.match(text[at]) is not None and rest(at + 1)


def _single(op, arg):
    data = re._parser.SubPattern(re._parser.State(), [(op, arg)])
    data.state.str = ""
    return data


@pytest.mark.parametrize("pattern, unit, tail", [(r"^a*b", "a", "!"), (r"a*b", "a", "!"), (r"^a*a*b", "a", "!"), (r"a*a*b", "a", "!"), (r"(ab|ba)+c", "ab", "!"), (r"x[^y]*y", "x", "!"), (r"k=[a-z]*;", "k=", "!")])
def test_power_is_that_of_the_steps(pattern, unit, tail):
    """Twice the text takes about two to the power as many steps."""
    kind, power = patterns.growth(pattern)
    assert kind in ("linear", "polynomial")
    counts = []
    for n in (20, 40):
        steps = Steps(pattern)
        steps.search(unit * n + tail, 10_000_000)
        counts.append(steps.n)
    assert 2 ** (power - 0.6) < counts[1] / counts[0] < 2 ** (power + 0.4)


@pytest.mark.parametrize("pattern, unit", [(r"(a+)+b", "a"), (r"(a|aa)+b", "a"), (r"(?:\d{1,4}\.?)+x", "1"), (r"(\w+){5,9}!", "a")])
def test_exponential_ones_explode(pattern, unit):
    assert patterns.growth(pattern)[0] == "exponential"
    assert Steps(pattern).search(unit * 40, 300_000) is None


ATTACKS = ["a", "ab", "1", "1.", " ", "<a", "x", "k=", "a@", "\n", "$ ", "Licensed under A "]


def test_no_usable_pattern_takes_long_on_a_megabyte(spark):
    usable = [p for p in [*KNOWN, "foo.*bar.*baz", r"(?:ab|cd)+e", r"(\w{1,9} )+z"] if patterns.usable(p)]
    assert len(usable) > 12
    texts = [(unit * (1_000_000 // len(unit)) + "!",) for unit in ATTACKS]
    df = spark.createDataFrame(texts, "t string").repartition(4).cache()
    df.count()
    for p in usable:
        began = time.time()
        df.select(patterns.search(F.col("t"), p).alias("hit")).agg(F.count_if("hit")).collect()
        assert time.time() - began < 8, p


def test_search_and_extract_over_both_engines(spark):
    df = spark.createDataFrame([("a ab@cd.ef g",), ("none",), (None,), ("x@y.z k@l.m",)], "t string")
    for p, g in ((r"(\w+)@(\w+)", 2), (r"@(\w)", 1), (r"(?P<who>\w+)@[(\]\w]+(?:\.)(\w)", 2), (r"b@(c)?", 1)):
        got = df.select("t", patterns.search(F.col("t"), p).alias("hit"), patterns.extract(F.col("t"), p, g).alias("part")).collect()
        for r in got:
            m = re.search(p, r.t) if r.t is not None else None
            assert bool(r.hit) == bool(m) and r.part == ((m[g] or "") if m else None)
    assert patterns.engine(r"(\w+)@(\w+)") == "re2" and patterns.engine(r"@(\w)") == "jvm"


def test_refused_patterns_leave_steps_out(spark):
    df = spark.createDataFrame([("aaa!",), ("b",)], "t string")
    for p in (r"(a+)+$", "(", r"(a)\1"):
        assert not rows.regex_is_safe(p)
        assert rows.filter_rows(df, "t", "regex", p).count() == 2 and rows.validate_rows(df, "t", pattern=p).count() == 2
        assert rows.regex_extract(df, "t", p).columns == ["t"]


def test_growth_of_a_column(spark):
    df = spark.createDataFrame([("a+",), (None,), ("(a+)+b",)], "p string").withColumn("p_power", F.lit("x"))
    got = {r.p: (r.p_growth, r.p_power, r.p_engine) for r in rows.pattern_growth(df, "p").collect()}
    assert got == {"a+": ("linear", 1, "jvm"), None: (None, None, None), "(a+)+b": ("exponential", 0, "none")}
