"""Attributes read from stone product names, and their scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import ladder, or_false

NUMBER = r"\d+(?:[.,]\d+)?"
NUMBER_OR_RANGE = NUMBER + r"(?:\s*-\s*" + NUMBER + r")?"
# Name patterns, in order of precedence.
CUTS = {
    "Brilliant": r"\bbrilliant\b|\bbrill\b", "Cabochon": r"\bcabochon\b|\bcab\b", "Rose Cut": r"\brose\s*cut\b|\brose\b",
    "Briolette": r"\bbriolette\b", "Step Cut": r"\bstep\s*cut\b", "Faceted": r"\bfaceted\b|\bfacet\b",
}
DRILLS = {
    "Half Drill": r"\bhalf\s*drill\b|\bhalf\s*dril\b|\bhalf\s*hole\b", "Top Drill": r"\btop\s*drill\b",
    "Full Drill": r"\bfull\s*drill\b|\bfull\s*drilll\b", "Center Drill": r"\bcenter\s*drill\b", "No Drill": r"\bno\s*drill\b",
}
PEARL_SHAPES = {
    "Baroque": r"\bbaroque\b", "Potato": r"\bpotato\b", "Rice": r"\brice\b", "Button": r"\bbutton\b",
    "Near Round": r"\bnear\s*round\b|\bsemi\s*round\b", "Oval": r"\boval\b", "Drop": r"\bdrop\b",
    "Coin / UFO / Mabe": r"\bcoin\b|\bufo\b|\bmabe\b", "Round": r"\bround\b",
}
MISSPELLED_MARQUISE = r"\bmaquire\b"
GEM_SHAPES = {
    "Emerald Cut": r"\bemerald\s+cut\b", "Heart": r"\bheart\b", "Star": r"\bstar\b", "Marquise": r"\bmarquise\b",
    "Trillion": r"\btrillion\b|\btrilliant\b", "Princess": r"\bprincess\b", "Pear": r"\bpear\b", "Drop": r"\bdrop\b", "Egg": r"\begg\b",
    "Onion": r"\bonion\b", "Baguette": r"\bbaguette\b", "Rectangle": r"\brectangle\b|\brectangular\b|\boctagon\b|\bsquare\b",
    "Cushion": r"\bcushion\b", "Oval": r"\boval\b", "Round": r"\bround\b|\brd\b",
}
DRILL_SIZES = [
    rf"(?:top|half|full|center)\s*(?:drill|drilll|hole)\s*(?:{NUMBER}\s*[xX*]\s*{NUMBER}(?:\s*mm)?)",
    rf"\((?:top|half|full|center)\s*(?:drill|drilll|hole)\)\s*(?:{NUMBER}\s*[xX*]\s*{NUMBER}(?:\s*mm)?)",
    rf"(?:{NUMBER}\s*[xX*]\s*{NUMBER}\s*mm?)\s*hole",
    rf"(?:top|half|full|center)\s*drill\s*(?:{NUMBER}\s*[xX*]\s*{NUMBER})?",
]
# Scores.
MATERIAL_SCORES = {"No Stone": 0, "Synthetic stone": 5, "Pearl": 7, "Natural stone": 8, "Diamond": 10}
GEM_SCORES = {
    "Round": 5, "Oval": 6, "Cushion": 6, "Baguette": 7, "Rectangle": 7, "Pear": 8, "Drop": 8, "Egg": 8, "Onion": 8, "Princess": 8,
    "Marquise": 9, "Trillion": 9, "Emerald Cut": 9, "Heart": 10, "Star": 10,
}
PEARL_SCORES = {
    "Round": 5, "Near Round": 6, "Button": 6, "Oval": 7, "Potato": 7, "Coin / UFO / Mabe": 7, "Rice": 8, "Drop": 9, "Baroque": 10,
}
PEARL_MM = [(3.0, 1), (4.0, 2), (5.0, 3), (6.0, 4), (7.0, 5), (8.0, 6), (9.0, 7), (10.5, 8), (12.0, 9)]
GEM_CARAT = [(0.005, 1), (0.015, 2), (0.035, 3), (0.085, 4), (0.22, 5), (0.55, 6), (1.30, 7), (3.00, 8), (6.00, 9)]


def _first_match(text: Column, patterns: dict[str, str]) -> Column:
    chain = None
    for label, pattern in patterns.items():
        chain = (F.when if chain is None else chain.when)(text.rlike(pattern), F.lit(label))
    return chain


def _lookup(value: Column, table: dict[str, int]) -> Column:
    chain = None
    for key, score in table.items():
        chain = (F.when if chain is None else chain.when)(value == key, F.lit(float(score)))
    return chain


def cut_profile(text: Column) -> Column:
    """Cuts in the order they appear in the name."""
    found = [
        F.when(text.rlike(p), F.struct(F.length(F.split(text, p, 2)[0]).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("cut")))
        for i, (name, p) in enumerate(CUTS.items())
    ]
    ordered = F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda x: x["cut"])
    return F.nullif(F.array_join(ordered, "; "), F.lit(""))


def with_shape(df: DataFrame) -> DataFrame:
    """Pearl flag, shape family, shape and its source, cut profile and drill type."""
    text = F.lower("ProductName")
    pearl = (F.col("StoneType") == "Pearl") | text.rlike(r"\bpearl\b")
    found = F.when(pearl, _first_match(text, PEARL_SHAPES)).when(text.rlike(MISSPELLED_MARQUISE), "Marquise").otherwise(_first_match(text, GEM_SHAPES))
    source = F.when(~pearl & text.rlike(MISSPELLED_MARQUISE), "Corrected").when(found.isNotNull(), "Explicit").otherwise("Default")
    return df.withColumns(
        {
            "IsPearl": pearl,
            "ShapeFamily": F.when(pearl, "Pearl").otherwise("Gemstone"),
            "StoneShape": F.coalesce(found, F.lit("Round")),
            "ShapeSource": source,
            "CutProfile": cut_profile(text),
            "PearlDrillType": _first_match(text, DRILLS),
            "PearlLikeMaterialMismatch": pearl & (F.col("StoneType") != "Pearl"),
        }
    )


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda s: F.regexp_replace(s, ",", ".").cast("double"))


def with_size(df: DataFrame) -> DataFrame:
    """MajorSizeMm: the largest dimension of the best size in the name, drill sizes removed.

    Sizes with a unit come first, preferring plain over height/thickness ones, then more
    dimensions, then the larger value; unmarked a x b sizes and truncated endings follow.
    """
    text = F.col("ProductName")
    for pattern in DRILL_SIZES:
        text = F.regexp_replace(text, "(?i)" + pattern, " [DRILL_REMOVED] ")
    marked = rf"(?i)({NUMBER_OR_RANGE}(?:\s*[xX*]\s*{NUMBER_OR_RANGE})*)\s*(?:mm|m\b)"
    unmarked = rf"\b({NUMBER_OR_RANGE}(?:\s*[xX*]\s*{NUMBER_OR_RANGE})+)\b"
    staged = df.withColumn("__text", text)
    # A secondary size is announced within the fifteen characters before it, earlier sizes among them.
    between, sizes = F.split(F.regexp_replace("__text", marked, "\u0001"), "\u0001"), F.regexp_extract_all("__text", F.lit(marked), F.lit(0))
    staged = staged.withColumns({"__between": between, "__whole": sizes})

    def before(i: Column) -> Column:
        passed = F.zip_with(F.slice("__between", F.lit(1), i), F.slice("__whole", F.lit(1), i), lambda a, b: F.concat(a, b))
        text = F.concat(F.array_join(passed, ""), F.element_at("__between", i + 1))
        return F.lower(F.right(text, F.lit(15)))

    staged = staged.withColumns(
        {
            "__sizes": F.regexp_extract_all("__text", F.lit(marked), F.lit(1)),
            "__lead": F.when(F.size("__whole") > 0, F.transform(F.sequence(F.lit(0), F.size("__whole") - 1), before)).otherwise(F.array().cast("array<string>")),
            "__plain": F.regexp_extract_all("__text", F.lit(unmarked), F.lit(1)),
            "__cut": F.regexp_extract(F.trim("__text"), rf"(?i)({NUMBER})\s*x\s*$", 1),
            "__range": F.regexp_extract(F.trim("__text"), rf"({NUMBER})\s*-\s*(\d+)?\.?$", 1),
        }
    )

    def candidate(size: Column, lead: Column) -> Column:
        parts = F.split(size, r"[xX*]")
        announced = lead.contains("h=") | lead.contains("hi=") | lead.contains("h ") | lead.contains("thickness")
        return F.struct((~announced).cast("int").alias("plain"), F.size(parts).alias("dims"), F.array_max(_numbers(size)).alias("mm"))

    best = F.array_max(F.zip_with("__sizes", F.slice("__lead", F.lit(1), F.size("__sizes")), candidate))
    fallback = F.array_max(F.transform("__plain", lambda s: candidate(s, F.lit(""))))
    ending = F.coalesce(F.nullif("__cut", F.lit("")), F.nullif("__range", F.lit("")))
    size = F.coalesce(best["mm"], fallback["mm"], F.regexp_replace(ending, ",", ".").cast("double"))
    return staged.withColumn("MajorSizeMm", size).drop("__text", "__between", "__whole", "__sizes", "__lead", "__plain", "__cut", "__range")


def with_scores(df: DataFrame) -> DataFrame:
    """Material, shape and unit-size scores with the source of the size."""
    carat = F.col("UnitWeightGram") * 5.0
    shape = F.when(F.col("IsPearl"), F.coalesce(_lookup(F.col("StoneShape"), PEARL_SCORES), F.lit(5.0))).otherwise(
        F.coalesce(_lookup(F.col("StoneShape"), GEM_SCORES), F.lit(5.0))
    )
    size = F.when(F.col("IsPearl"), ladder(F.col("MajorSizeMm"), PEARL_MM, 10)).otherwise(ladder(carat, GEM_CARAT, 10))
    source = (
        F.when(F.col("IsPearl"), F.when(F.col("MajorSizeMm").isNotNull(), "Pearl mm").otherwise("Missing"))
        .when(carat.isNotNull(), "Carat")
        .when(F.col("MajorSizeMm").isNotNull(), "mm fallback pending calibration")
        .otherwise("Missing")
    )
    notes = F.concat_ws(
        "; ",
        F.when(F.col("IsPearl") & F.col("MajorSizeMm").isNull(), F.lit("Pearl missing mm size")),
        F.when(source == "mm fallback pending calibration", F.lit("Non-pearl carat missing; mm parsed but pending calibration")),
        F.when(~F.col("IsPearl") & (source == "Missing"), F.lit("Non-pearl missing weight and mm")),
        F.when(F.col("StoneType") == "Old stone (unspecified)", F.lit("Material is unspecified/old stone")),
        F.when(or_false(F.col("PearlLikeMaterialMismatch")), F.lit("Pearl-like shape on non-pearl material")),
    )
    return df.withColumns(
        {
            "UnitWeightCarat": carat, "MaterialScore": _lookup(F.col("StoneType"), MATERIAL_SCORES), "ShapeScore": shape,
            "UnitSizeScore": size, "UnitSizeSource": source, "ScoreNote": F.nullif(notes, F.lit("")),
        }
    )


def stone_attributes(df: DataFrame) -> DataFrame:
    """All name attributes and scores of a stone table (StoneSku, StoneType, UnitWeightGram, ProductName)."""
    return with_scores(with_size(with_shape(df)))
