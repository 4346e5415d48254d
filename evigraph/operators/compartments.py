"""Locations named by ontology terms, mapped to physical zones.

A term takes the zones of its nearest anchors: those are found for all terms at
once, by labelling that spreads from the anchors to their children, one step a
round.  A term is labelled once, with all anchors at its least distance, so a
round writes a row for each newly labelled term and anchor tied there, and a
closure of all ancestors never exists.  Terms without an anchor above them are
mapped by the first keyword rule that their name fits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.sources.state import cut


@dataclass(frozen=True)
class Keyword:
    needles: tuple[str, ...]
    zones: dict[str, float]
    reason: str


def _keywords(text: str) -> tuple[Keyword, ...]:
    """Lines of ``needles | zones with weights | reason``."""
    rules = []
    for line in filter(None, (x.strip() for x in text.splitlines())):
        needles, zones, reason = (part.strip() for part in line.split("|"))
        weights = {zone: float(weight) for zone, weight in (z.split() for z in zones.split(","))}
        rules.append(Keyword(tuple(n.strip() for n in needles.split(",")), weights, reason))
    return tuple(rules)


#: The first line one of whose needles a lower-cased name holds gives its zones.
KEYWORDS = _keywords("""
mitochondrial inner membrane | mitochondrial_inner_membrane 1 | mitochondrial inner membrane
mitochondrial outer membrane | mitochondrial_outer_membrane 1 | mitochondrial outer membrane
mitochondrial matrix | mitochondrial_matrix 1 | mitochondrial matrix
intermembrane space | mitochondrial_intermembrane_space 1 | mitochondrial intermembrane space
endoplasmic reticulum membrane, er membrane | er_membrane 1 | ER membrane
endoplasmic reticulum lumen, er lumen | er_lumen 1 | ER lumen
golgi membrane | golgi_membrane 1 | Golgi membrane
golgi lumen | golgi_lumen 1 | Golgi lumen
endosome membrane, endosomal membrane | endosome_membrane 1 | endosome membrane
endosome lumen, endosomal lumen | endosome_lumen 1 | endosome lumen
lysosome membrane, lysosomal membrane | lysosome_membrane 1 | lysosome membrane
lysosome lumen, lysosomal lumen | lysosome_lumen 1 | lysosome lumen
peroxisome membrane, peroxisomal membrane | peroxisome_membrane 1 | peroxisome membrane
peroxisome matrix, peroxisomal matrix | peroxisome_matrix 1 | peroxisome matrix
ciliary membrane | ciliary_membrane 1 | ciliary membrane
plasma membrane | plasma_membrane 1 | plasma membrane
nuclear envelope, nuclear membrane | nuclear_envelope 1 | nuclear envelope
extracellular, basement membrane | extracellular_space 1 | extracellular
cell junction, focal adhesion | cell_surface_junction 1 | cell-surface junction
lipid droplet | lipid_droplet_surface 1 | lipid droplet
chromosome, chromatin, nucleol, nucleoplasm, nuclear body, nuclear speckle | nucleus_interior 1 | nucleus interior
ruffle, lamellipodium, pseudopodium, cell leading edge, growth cone, brush border, uropod, cell periphery, cell surface, apical part of cell, basal part of cell, subapical part of cell, basolateral part of cell, glial limiting end-foot | plasma_membrane 0.4, cytoskeleton 0.35, cytosol_bulk 0.25 | coarse cortical or cell-surface region
axon, dendrite, neuron projection, cell projection, neuronal cell body, cell body, perikaryon, astrocyte projection, glial cell projection | cytoplasm_general 0.5, plasma_membrane 0.25, cytoskeleton 0.25 | coarse cellular projection or regional morphology
myelin sheath, internode region, node of ranvier, paranode region, schmidt-lanterman incisure | generic_membrane 0.7, cytoskeleton 0.15, extracellular_space 0.15 | coarse myelin or axoglial membrane region
intercellular bridge, contractile ring, flemming body, basal body patch | cytoskeleton 1 | cytoskeletal cell-division structure
photoreceptor inner segment | cytoplasm_general 0.5, generic_membrane 0.25, cilium_interior 0.25 | coarse photoreceptor cellular region
sperm head-tail coupling apparatus, lateral loop | sperm_specialized_structure 1 | sperm-specific structure
organelle | intracellular_unspecified 1 | unresolved organelle
phospholipid-translocating atpase complex | generic_membrane 1 | membrane-embedded ATPase complex
cytoskeleton, microtubule, actin filament, centrosome, spindle, midbody, centriolar | cytoskeleton 1 | cytoskeleton
cytosol | cytosol_bulk 1 | cytosol
cytoplasmic | cytoplasm_general 1 | cytoplasm
vesicle membrane, autophagosome membrane, phagosome membrane, vacuolar membrane | vesicle_membrane 1 | generic vesicle membrane
vesicle lumen, vacuole lumen, granule lumen | vesicle_lumen 1 | generic vesicle lumen
cilium, ciliary | cilium_interior 0.6, ciliary_membrane 0.4 | cilium
membrane | generic_membrane 1 | generic membrane
intracellular | intracellular_unspecified 1 | intracellular
""")


def primary_links(links: DataFrame, terms: DataFrame, alternatives: DataFrame | None = None) -> DataFrame:
    """(child, parent) between known terms (id), with alternative ids (alternative, id) put in their primary's place."""
    rows = links.select("child", "parent")
    if alternatives is not None:
        a = alternatives.groupBy("alternative").agg(F.max("id").alias("id"))
        for end in ("child", "parent"):
            rows = rows.join(a.select(F.col("alternative").alias(end), "id"), end, "left").withColumn(end, F.coalesce("id", end)).drop("id")
    known = terms.select("id").distinct()
    for end in ("child", "parent"):
        rows = rows.join(known.withColumnRenamed("id", end), end, "left_semi")
    return rows.select("child", "parent").where("child <> parent").distinct()


def nearest_anchors(links: DataFrame, anchors: DataFrame, max_rounds: int = 256) -> DataFrame:
    """(node, anchor, distance): all anchors (anchor) at a node's least distance up the links (child, parent), cycles or not; anchors are their own."""
    down = cut(links.select(F.col("parent").alias("node"), "child").distinct(), "links")
    front = cut(anchors.select(F.col("anchor").alias("node"), "anchor").where("anchor IS NOT NULL").distinct().withColumn("distance", F.lit(0)), "anchors")
    seen = front
    for distance in range(1, max_rounds + 1):
        reached = front.join(down, "node").select(F.col("child").alias("node"), "anchor").distinct()
        # a node is labelled in one round only
        front = cut(reached.join(seen.select("node").distinct(), "node", "left_anti").withColumn("distance", F.lit(distance)), "anchors")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError(f"terms more than {max_rounds} steps from an anchor")


def normalised(zones: Column) -> Column:
    """Positive weights of a map, scaled to 1; null if there are none."""
    kept = F.map_filter(zones, lambda _, w: w > 0)
    total = F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, w: a + w)
    return F.when(total > 0, F.transform_values(kept, lambda _, w: w / total))


def by_keyword(name: Column, rules: tuple[Keyword, ...] = KEYWORDS) -> Column:
    """(zones, reason) of the first rule that a name fits, else null."""
    lowered = F.lower(name)
    out = F.lit(None).cast("struct<zones:map<string,double>,reason:string>")
    for rule in reversed(rules):
        fits = F.lit(False)
        for needle in rule.needles:
            fits = fits | F.contains(lowered, F.lit(needle))
        total = sum(rule.zones.values())
        zones = F.create_map(*[F.lit(x) for zone, weight in rule.zones.items() for x in (zone, weight / total)])
        out = F.when(fits, F.struct(zones.alias("zones"), F.lit(rule.reason).alias("reason"))).otherwise(out)
    return out


def mapped_locations(
    locations: DataFrame, terms: DataFrame, links: DataFrame, anchors: DataFrame, alternatives: DataFrame | None = None, rules: tuple[Keyword, ...] = KEYWORDS
) -> DataFrame:
    """(location, id, zones, method, confidence, evidence, priority) of every location (location, name).

    ``terms``: (id, name); ``anchors``: (anchor, zones, specificity, description).
    Tied anchors' weights add up; of their specificities ``specific`` alone gives high
    confidence, any ``generic`` low, the rest moderate.  A location whose own name is
    empty or an id takes its term's.
    """
    rows = locations.select("location", F.coalesce("name", F.lit("")).alias("own_name")).withColumn("id", F.col("location"))
    if alternatives is not None:
        a = alternatives.groupBy("alternative").agg(F.max("id").alias("primary"))
        rows = rows.join(a, F.col("location") == F.col("alternative"), "left").withColumn("id", F.coalesce("primary", "location")).select("location", "own_name", "id")
    named = terms.groupBy("id").agg(F.max(F.coalesce("name", F.lit(""))).alias("term_name"))
    rows = rows.join(named, "id", "left")
    found = nearest_anchors(primary_links(links, terms, alternatives), anchors.join(named.select(F.col("id").alias("anchor")), "anchor", "left_semi"))
    labelled = found.join(anchors.select("anchor", "zones", "specificity", "description"), "anchor")
    shares = labelled.select("node", F.explode("zones").alias("zone", "weight")).groupBy("node", "zone").agg(F.sum("weight").alias("weight"))
    shares = shares.groupBy("node").agg(normalised(F.map_from_entries(F.array_sort(F.collect_list(F.struct("zone", "weight"))))).alias("zones"))
    why = F.concat_ws(":", F.col("anchor").cast("string"), "description", F.concat(F.lit("distance="), F.col("distance").cast("string")))
    facts = labelled.groupBy("node").agg(
        F.bool_and(F.col("specificity") == "specific").alias("specific"), F.bool_or(F.col("specificity") == "generic").alias("generic"), F.array_join(F.array_sort(F.collect_list(why)), ";").alias("anchored")
    )
    rows = rows.join(shares.join(facts, "node").withColumnRenamed("node", "id"), "id", "left")
    name = F.when(F.col("term_name").isNotNull() & ((F.col("own_name") == "") | F.col("own_name").startswith("GO:")), F.col("term_name")).otherwise(F.col("own_name"))
    rows = rows.withColumn("word", F.when(F.col("zones").isNull(), by_keyword(name, rules)))
    anchored, worded = F.col("zones").isNotNull(), F.col("word").isNotNull()
    sure = F.when(~anchored, "low").when(F.col("specific"), "high").when(F.col("generic"), "low").otherwise("moderate")
    missing = F.when(F.col("term_name").isNull(), "go_id_not_in_release").otherwise("no_anchor_ancestor")
    return rows.select(
        "location", "id",
        F.coalesce("zones", "word.zones").alias("zones"),
        F.when(anchored, "go_ancestor_anchor").when(worded, "keyword_fallback").otherwise(missing).alias("method"),
        sure.alias("confidence"),
        F.when(anchored, F.col("anchored")).when(worded, F.col("word.reason")).otherwise("").alias("evidence"),
        F.when(~anchored & ~worded, "critical").when(sure == "low", "high").when(sure == "moderate", "medium").otherwise("routine").alias("priority"),
    )
