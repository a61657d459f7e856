"""Samples from a template grammar: every row of a template's product is computed from its number, so nothing is drawn twice or thrown away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import let
from folio.operators import names
from folio.operators.sampling import keep_first, ranked

SLOT = r"\{(\w+(?::\w+)?)\}"
LARGEST = 2**62  # rows of one template
BLOCK = 4096  # rows that one row of the draw stands for
#: Three primes whose product is over ``LARGEST``, so one of them is coprime to any number of rows.
STEPS = (1_000_003, 999_983, 998_244_353)
SIZED = "array<struct<slot:string,pool:string,nth:int,radix:bigint,weight:bigint>>"


def slots_of(template: Column) -> Column:
    """array<string>: the distinct slots of a template, in order. ``{a}`` and ``{a:x}`` take different fillers of pool a."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(SLOT), F.lit(1)))


def sized(templates: DataFrame, fillers: DataFrame) -> DataFrame:
    """Distinct (domain, template_id, template) with ``slots`` (each with its radix and the product of those before) and ``total``, the rows of the product.

    A pool's second slot has one filler less to choose from. A template without slots has one row, one whose pool lacks
    fillers none; more than ``LARGEST`` rows are an error.
    """
    keys = ["domain", "template_id", "template"]
    rows = templates.select(*keys).where("template is not null").distinct()
    pools = fillers.where("filler is not null").groupBy("domain", "pool").agg(F.count_distinct("filler").alias("n"))
    each = rows.select(*keys, slots_of(F.col("template")).alias("all")).select(*keys, F.posexplode("all").alias("at", "slot")).withColumn("pool", F.split_part("slot", F.lit(":"), F.lit(1)))
    own = W.partitionBy(*keys, "pool").orderBy("at")
    each = each.withColumn("nth", F.row_number().over(own) - 1).join(pools, ["domain", "pool"], "left")
    each = each.withColumn("radix", F.greatest(F.coalesce("n", F.lit(0)) - F.col("nth"), F.lit(0)).cast("long"))
    packed = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "slot", "pool", "nth", "radix"))).alias("s"))
    start = F.struct(F.lit(1).cast("long").alias("total"), F.array().cast(SIZED).alias("slots"))

    def step(a: Column, x: Column) -> Column:
        slot = F.struct(x["slot"].alias("slot"), x["pool"].alias("pool"), x["nth"].alias("nth"), x["radix"].alias("radix"), a["total"].alias("weight"))
        grown = F.when((a["total"] < 0) | (a["total"] > F.expr(str(LARGEST)) / F.greatest(x["radix"], F.lit(1))), -1).otherwise(a["total"] * x["radix"])  # -1: too many
        return F.struct(grown.alias("total"), F.concat(a["slots"], F.array(slot)).alias("slots"))

    got = rows.join(packed, keys, "left").withColumn("__a", F.aggregate(F.coalesce("s", F.array().cast(packed.schema["s"].dataType)), start, step))
    fits = F.col("__a.total") >= 0
    return got.select(*keys, F.col("__a.slots").alias("slots"), F.when(fits, F.col("__a.total")).otherwise(F.raise_error(F.concat(F.lit("too many rows in template "), F.col("template_id"))).cast("long")).alias("total"))


def shared(sizes: DataFrame, quotas: DataFrame) -> DataFrame:
    """``sizes`` with ``drawn``: a domain's quota dealt evenly to its templates; what a small one can't fill goes to the others. Domains without a quota draw nothing.

    With templates by size, a template is drawn whole while what the quota leaves for it and all larger ones is enough for
    each to have as much; the others share what is left, the first ones by id one row more.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    rows = sizes.join(quotas.select("domain", "quota"), "domain").where("quota > 0")
    up = W.partitionBy("domain").orderBy("total", "template_id", "template")
    rows = rows.withColumn("__before", F.coalesce(F.sum(wide("total")).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("__rest", F.count("*").over(W.partitionBy("domain")) - F.row_number().over(up) + 1)
    rows = rows.withColumn("__whole", F.col("__before") + wide("total") * F.col("__rest") <= F.col("quota"))
    left = F.col("quota") - F.coalesce(F.sum(F.when(F.col("__whole"), F.col("total"))).over(W.partitionBy("domain")), F.lit(0))
    rows = rows.withColumn("__left", left).withColumn("__m", F.count_if(~F.col("__whole")).over(W.partitionBy("domain"))).withColumn("__i", F.row_number().over(W.partitionBy("domain", "__whole").orderBy("template_id", "template")))
    share = F.expr("__left div __m") + F.when(F.col("__i") <= F.col("__left") % F.col("__m"), 1).otherwise(0)
    return rows.withColumn("drawn", F.when(F.col("__whole"), F.col("total")).otherwise(share).cast("long")).select(*sizes.columns, "drawn")


def numbers(plan: DataFrame, seed: int) -> DataFrame:
    """The drawn numbers of each template: an arithmetic progression modulo ``total`` from a hashed start, all different as the step is coprime."""
    step = F.when(F.col("total") % STEPS[0] != 0, STEPS[0]).when(F.col("total") % STEPS[1] != 0, STEPS[1]).otherwise(STEPS[2])
    start = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), "domain", "template_id").cast("binary")), F.lit(15)), 16, 10).cast("long") % F.col("total")
    blocks = plan.where("drawn > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(drawn - 1) div " + str(BLOCK)))).alias("__b")).repartition("domain", "template_id", "__b")
    within = F.explode(F.sequence(F.col("__b") * BLOCK, F.least((F.col("__b") + 1) * BLOCK, F.col("drawn")) - 1))
    return blocks.select("*", within.alias("__i")).withColumn("number", (start + F.col("__i") * step) % F.col("total")).drop("__b", "__i")


def picks(slots: Column, number: Column) -> Column:
    """array<bigint>: the filler of each slot by its digit of the number; a pool's later slots count only the fillers that its earlier ones have left."""
    digit = F.transform(slots, lambda s: F.struct(s["pool"].alias("pool"), F.pmod(F.call_function("div", number, s["weight"]), s["radix"]).alias("d")))
    none = F.array().cast("array<struct<pool:string,k:bigint>>")

    def step(a: Column, x: Column) -> Column:
        taken = F.array_sort(F.transform(F.filter(a, lambda e: e["pool"] == x["pool"]), lambda e: e["k"]))
        place = F.aggregate(taken, x["d"], lambda k, t: F.when(k >= t, k + 1).otherwise(k))
        return F.concat(a, F.array(F.struct(x["pool"].alias("pool"), place.alias("k"))))

    return F.transform(F.aggregate(digit, none, step), lambda e: e["k"])


def rendered(template: Column, filled: Column) -> Column:
    """struct<text, spans> of a template whose slots are filled by a map; spans are (slot, surface, start, end) in order, and fillers are not searched for slots."""
    empty = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<slot:string,surface:string,start:int,end:int>>").alias("spans"))

    def of(parts: Column, marks: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            fill = F.coalesce(F.try_element_at(filled, x["mark"]), F.lit(""))
            before = F.concat(a["text"], x["part"])
            span = F.struct(x["mark"].alias("slot"), fill.alias("surface"), F.length(before).alias("start"), (F.length(before) + F.length(fill)).alias("end"))
            return F.struct(F.concat(before, fill).alias("text"), F.when(x["mark"].isNull(), a["spans"]).otherwise(F.concat(a["spans"], F.array(span))).alias("spans"))

        return F.aggregate(F.transform(parts, lambda p, i: F.struct(p.alias("part"), F.get(marks, i).alias("mark"))), empty, step)

    return let(F.regexp_extract_all(template, F.lit(SLOT), F.lit(1)), lambda marks: let(F.split(template, SLOT, -1), lambda parts: of(parts, marks)))


def generate(templates: DataFrame, fillers: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """domain, template_id, template, number, text, spans, fillers: samples of each domain by its quota, fewer only where all its templates have no more rows.

    ``templates`` has domain, template_id, template; ``fillers`` domain, pool, filler; ``quotas`` domain, quota. Pools of
    any size: fillers are numbered by counted ranges and meet the slots in an equi-join. Repeated fillers and nulls don't
    count. Two templates may still give one text: see ``distinct_from``.
    """
    plan = shared(sized(templates, fillers), quotas)
    numbered = ranked(fillers.where("filler is not null").select("domain", "pool", "filler").distinct(), ["domain", "pool"], F.col("filler"), "__k").select("domain", "pool", "filler", (F.col("__k") - 1).alias("k"))
    keys = ["domain", "template_id", "template", "number"]
    drawn = numbers(plan, seed).withColumn("__p", picks(F.col("slots"), F.col("number")))
    asked = drawn.select(*keys, F.explode_outer(F.arrays_zip("slots", "__p")).alias("s")).select(*keys, F.col("s.slots.slot").alias("slot"), F.col("s.slots.pool").alias("pool"), F.col("s.__p").alias("k"))
    met = asked.join(numbered, ["domain", "pool", "k"], "left")
    rows = met.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "filler")))).alias("fillers"))
    return rows.withColumn("__r", rendered(F.col("template"), F.col("fillers"))).select(*keys, "__r.text", "__r.spans", "fillers")


def skeleton(template: Column, filled: Column, masked: list[str], mark: str = "X") -> Column:
    """The text with ``mark`` for every filler of the masked pools: what two samples that differ in these alone share."""
    cover = F.transform_values(filled, lambda k, v: F.when(F.split_part(k, F.lit(":"), F.lit(1)).isin(*masked), F.lit(mark)).otherwise(v))
    return rendered(template, cover)["text"]


def masked_text(texts: DataFrame, words: DataFrame, keys: list[str], text_col: str = "text", mark: str = "X", into: str = "skeleton") -> DataFrame:
    """``texts`` with ``into``: the text with ``mark`` for each of the words (column surface), leftmost and longest first. ``keys`` tell rows apart."""
    found = names.longest_matches(texts.select(*keys, text_col), words, keys, text_col).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "surface"))).alias("__m"))
    zero = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))
    cut = F.aggregate("__m", zero, lambda a, x: F.struct(F.concat(a["text"], F.substring(F.col(text_col), a["next"], x["at"] - a["next"]), F.lit(mark)).alias("text"), (x["at"] + F.length(x["surface"])).alias("next")), lambda a: F.concat(a["text"], F.substring(F.col(text_col), a["next"], F.length(text_col))))
    return texts.join(found, keys, "left").withColumn(into, F.when(F.col("__m").isNull(), F.col(text_col)).otherwise(cut)).drop("__m")


def distinct_from(samples: DataFrame, held: DataFrame, order: list[str], text: str = "text", skeletons: str = "skeleton") -> DataFrame:
    """Samples whose text and skeleton equal none of the held rows', each text once: the first by ``order``. Anti-joins on digests; a null text is none."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    rows = samples.where(F.col(text).isNotNull()).withColumn("__d", digest(text)).withColumn("__s", digest(skeletons))
    for own, theirs in (("__d", text), ("__s", skeletons)):
        rows = rows.join(held.select(digest(theirs).alias(own)).where(F.col(own).isNotNull()).distinct(), own, "left_anti")
    return keep_first(rows, ["__d"], [F.col(c) for c in order]).select(*samples.columns)


def contrasts(samples: DataFrame, patches: list[tuple[str, str, str, str]], text: str = "text", label: str = "label") -> DataFrame:
    """Samples whose text is one small change away and whose label is another: ``samples`` with patch, text, label and evidence.

    A patch is (name, phrase, replacement, label). It applies where its phrase stands exactly once and the sample's label is
    another one; evidence is the replacement, which stands word for word in the new text.
    """
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("patch", "find", "put", "label"), p, strict=True))) for p in patches))
    body = F.col(text)
    once = lambda p: (F.instr(body, p["find"]) > 0) & (F.length(body) - F.length(F.replace(body, p["find"], F.lit(""))) == F.length(p["find"]))
    rows = samples.select("*", F.explode(F.filter(table, lambda p: once(p) & ~p["label"].eqNullSafe(F.col(label)))).alias("__p"))
    changed = F.replace(body, F.col("__p.find"), F.col("__p.put"))
    return rows.withColumns({"patch": F.col("__p.patch"), "evidence": F.col("__p.put"), text: changed, label: F.col("__p.label")}).drop("__p")
