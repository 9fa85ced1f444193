"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-8


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def let(body, **values: Column) -> Column:
    """body of a struct of the values, each of which is then evaluated once, however often body names it, lambdas included."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


#: Items that an inner fold takes: appending copies what is there, so folds go by blocks and cost grows in proportion to the items.
FOLD = 512


def running(items: Column, state: str, start: Column, kind: str, step, emit) -> Column:
    """array<kind> of emit(at, x) for each of the items, `at` being of the type `state`, from `start` on, and step(at, x) after each."""
    empty = F.expr(f"cast(array() as array<{kind}>)")
    none = F.expr(f"cast(array() as array<struct<at:{state},found:array<{kind}>>>)")

    def block(done: Column, some: Column) -> Column:
        begin = F.struct(F.coalesce(F.try_element_at(done, F.lit(-1))["at"], start).alias("at"), empty.alias("found"))
        return F.aggregate(some, begin, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.array_append(acc["found"], emit(acc["at"], x)).alias("found")))

    def whole(t: Column) -> Column:
        n = F.size(t["x"])
        blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / FOLD).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
        folded = F.aggregate(blocks, none, lambda done, b: F.array_append(done, block(done, F.slice(t["x"], b * FOLD + 1, F.lit(FOLD)))))
        return F.flatten(F.transform(folded, lambda x: x["found"]))

    return let(whole, x=items)


def normalise(x: Column) -> Column:
    """Divided by the sum; uniform where the sum isn't positive."""

    def divide(t: Column) -> Column:
        return F.when(t["s"] > 0, F.transform(t["x"], lambda v: v / t["s"])).otherwise(F.transform(t["x"], lambda _: F.lit(1.0) / F.size(t["x"])))

    return let(lambda t: let(divide, x=t["x"], s=total(t["x"])), x=x)


def entropy(p: Column) -> Column:
    """Entropy over that of the uniform distribution; 0 for a single outcome."""

    def of(t: Column) -> Column:
        h = F.aggregate(t["p"], F.lit(0.0), lambda s, v: s - F.greatest(v, F.lit(FLOOR)) * F.ln(F.greatest(v, F.lit(FLOOR))))
        return F.when(F.size(t["p"]) > 1, h / F.ln(F.size(t["p"]).cast("double"))).otherwise(0.0)

    return let(of, p=p)


def per_thousand(x: Column, n: Column) -> Column:
    return F.transform(x, lambda v: v / F.greatest(n, F.lit(1)) * 1000)


def blend(guess: Column, lexicon: Column, prior: Column, n_words: Column, half_at: float) -> Column:
    """struct<counts, strength>: counts drawn to the lexicon's by s = L / (L + half_at), L lexicon hits per 1,000 words."""

    def strength(t: Column) -> Column:
        rate = t["found"] / F.greatest(t["n"], F.lit(1)) * 1000
        s = F.when(rate > 0, rate / (rate + max(half_at, 1e-6))).otherwise(0.0)
        return let(mixed, guess=t["guess"], guessed=total(t["guess"]), found=t["found"], g=normalise(t["guess"]), p=normalise(t["prior"]), s=s)

    def mixed(t: Column) -> Column:
        m = normalise(F.zip_with(t["g"], t["p"], lambda g, p: (1 - t["s"]) * g + t["s"] * p))
        mass = (1 - t["s"]) * t["guessed"] + t["s"] * t["found"]
        counts = let(lambda u: F.transform(u["m"], lambda v: v * u["mass"]), m=m, mass=mass)
        return F.struct(F.when(t["s"] > 0, counts).otherwise(t["guess"]).alias("counts"), t["s"].alias("strength"))

    return let(strength, guess=guess, prior=prior, found=total(lexicon), n=n_words)


def softmax(x: Column) -> Column:
    def of(t: Column) -> Column:
        return let(lambda u: F.transform(u["e"], lambda v: v / u["s"]), e=t["e"], s=total(t["e"]))

    return let(of, e=let(lambda t: F.transform(t["x"], lambda v: F.exp(v - t["m"])), x=x, m=F.array_max(x)))


def blend_prior(prior: Column, logits: Column, strength: float = 0.3) -> Column:
    """(1 - strength) softmax(logits) + strength prior, made a distribution."""
    return normalise(F.zip_with(softmax(logits), prior, lambda p, q: (1 - strength) * p + strength * q))


def noisy_or(p: Column) -> Column:
    return 1 - F.aggregate(p, F.lit(1.0), lambda s, v: s * (1 - v))


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rescale_vad(x: Column, mode: Column | str) -> Column:
    """From 0 to 1 or from 1 to 9 to -1 to 1; other values are clamped."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.when(mode == "zero_one", clamp(2 * x - 1)).when(mode == "one_nine", clamp((x - 5) / 4)).otherwise(clamp(x))


def salience(v: Column, a: Column) -> Column:
    """The larger of how far valence is from neutral and positive arousal."""
    return F.greatest(F.least(F.abs(v), F.lit(1.0)), clamp(a, 0.0, 1.0))


def align(vector: Column, names: Column, wanted: list[str]) -> Column:
    """The vector in the order of wanted names; an error where a name is missing or the sets differ."""
    fits = (F.size(names) == len(wanted)) & (F.size(F.array_except(names, F.array(*map(F.lit, wanted)))) == 0) & (F.size(vector) == len(wanted))
    ordered = F.array(*[F.element_at(vector, F.array_position(names, n).cast("int")) for n in wanted])
    return F.when(fits, ordered).otherwise(F.raise_error(F.lit("emotion names differ")).cast("array<double>"))
