"""A drug lexicon from product records, a list of names, and what must not be in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessalith.functions.text import split_name

SHORTEST = 4

# Words that product names contain and that are no drug by themselves.
BLOCKLIST = tuple(
    """
    sodium chloride potassium calcium magnesium citrate carbonate bicarbonate phosphate sulfate sulphate acetate
    hydrochloride hydrocloride hydroxide oxide peroxide tartrate maleate succinate fumarate gluconate lactate nitrate
    bromide iodide borate silicate besylate mesylate tosylate palmitate stearate water alcohol ethanol glycerin glycerol
    petrolatum lanolin paraffin starch dextrose sucrose lactose cream gel ointment powder solution syrup lotion tablet
    tablets capsule capsules injection spray unspecified kit swab patch film suspension glucose oxygen nitrogen helium
    air posterior anterior gland pituitary thyroid adrenal cholesterol bilirubin creatinine albumin hemoglobin
    haemoglobin protein collagen keratin placenta cartilage marrow mucosa drops unit units dose strength oral topical
    transdermal ophthalmic otic nasal rectal vaginal inhalation intravenous sublingual recombinant lactated
    dihydrochloride hydrobromide bitartrate disodium monohydrate dihydrate anhydrous acetonide propionate dipropionate
    valerate furoate xinafoate hyclate polistirex meglumine medoxomil officinalis scrofa horridus cells dehydrated
    delayed chewable ethinyl dimesylate
    """.split()
) + ("carbon dioxide",)


def terms_of_records(records: DataFrame) -> DataFrame:
    """(term, kind) with kind ``generic`` (product and ingredient names) or ``brand``; missing fields give nothing."""
    names = F.transform(F.coalesce("active_ingredients", F.array().cast("array<struct<name:string>>")), lambda i: split_name(i["name"]))
    generic = F.array_union(split_name(F.col("generic_name")), F.array_distinct(F.flatten(names)))
    tagged = lambda terms, kind: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind")))
    both = F.concat(tagged(generic, "generic"), tagged(split_name(F.col("brand_name")), "brand"))
    return records.select(F.explode(both).alias("t")).select("t.term", "t.kind").distinct()


def _blocked(term: Column) -> Column:
    return term.isin(*BLOCKLIST)


def component_terms(generic: DataFrame, english: DataFrame | None = None) -> DataFrame:
    """(term): single words of names of several words: letters only, four at least, neither blocked nor an English word."""
    parts = generic.select(F.split(F.trim(F.lower("term")), r"\s+").alias("p")).filter(F.size("p") >= 2).select(F.explode("p").alias("term"))
    out = parts.filter(F.col("term").rlike(f"^[a-z]{{{SHORTEST},}}$") & ~_blocked(F.col("term"))).distinct()
    return out if english is None else out.join(english.toDF("term"), "term", "left_anti")


def clean_terms(terms: DataFrame, brand_only: DataFrame | None = None, english: DataFrame | None = None) -> DataFrame:
    """(term): long enough, with a letter, not blocked as a whole; a brand that is one English word goes."""
    term = F.lower(F.trim("term"))
    out = terms.select(term.alias("term")).distinct().filter((F.length("term") >= SHORTEST) & F.col("term").rlike("[a-z]") & ~_blocked(F.col("term")))
    if brand_only is None or english is None:
        return out
    common = brand_only.select("term").join(english.toDF("term"), "term", "left_semi").filter(~F.col("term").contains(" "))
    return out.join(common, "term", "left_anti")


def build(records: DataFrame, names: DataFrame, english: DataFrame | None = None) -> DataFrame:
    """(term) of the whole lexicon: generic names, their components, listed names, and brands that are none of these."""
    found = terms_of_records(records)
    generic = found.filter("kind = 'generic'").select("term")
    trusted = generic.union(component_terms(generic, english)).union(names.toDF("term")).distinct()
    brand_only = found.filter("kind = 'brand'").select("term").join(trusted, "term", "left_anti")
    return clean_terms(trusted.union(brand_only), brand_only, english)
