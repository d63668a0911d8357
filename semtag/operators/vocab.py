"""Vocabularies as small tables: types in order, coarse types, aliases, settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import shorten_iri

# Type ids and roll-ups of the shipped vocabularies.
COARSE = [
    "NER:PERSON", "NER:ORGANIZATION", "NER:LOCATION", "NER:EVENT", "NER:WORK_OF_ART", "NER:PRODUCT",
    "NER:DATE_TIME", "NER:NUMBER", "NER:MONEY", "NER:PERCENT", "NER:LAW_OR_REGULATION", "NER:OTHER",
]
FINE_TO_COARSE = {
    "NER:PERSON.ENTREPRENEUR": "NER:PERSON",
    "NER:PERSON.POLITICIAN": "NER:PERSON",
    "NER:ORG.COMPANY": "NER:ORGANIZATION",
    "NER:ORG.UNIVERSITY": "NER:ORGANIZATION",
    "NER:ORG.RESEARCH_INSTITUTE": "NER:ORGANIZATION",
    "NER:LOC.CITY": "NER:LOCATION",
    "NER:LOC.COUNTRY": "NER:LOCATION",
    "NER:PRODUCT.DEVICE": "NER:PRODUCT",
    "NER:EVENT.CONFERENCE": "NER:EVENT",
    "NER:OTHER": "NER:OTHER",
}
STI_TO_COARSE = {
    "NE:PERSON": "NE:PERSON", "NE:ORGANIZATION": "NE:ORGANIZATION", "NE:LOCATION": "NE:LOCATION", "NE:OTHER": "NE:OTHER",
    "LIT:STRING": "LIT:STRING", "LIT:NUMBER": "LIT:NUMBER", "LIT:DATETIME": "LIT:DATETIME",
    "xsd:string": "LIT:STRING", "xsd:boolean": "LIT:STRING", "xsd:integer": "LIT:NUMBER", "xsd:decimal": "LIT:NUMBER",
    "xsd:date": "LIT:DATETIME", "xsd:dateTime": "LIT:DATETIME", "xsd:anyURI": "LIT:STRING",
    "ext:email": "LIT:STRING", "ext:ipv4": "LIT:STRING", "ext:ipv6": "LIT:STRING", "ext:phone": "LIT:STRING",
    "ext:uuid": "LIT:STRING", "ext:url": "LIT:STRING", "ext:postalCode": "LIT:STRING", "ext:countryCode": "LIT:STRING",
    "ext:currencyCode": "LIT:STRING", "ext:lat": "LIT:NUMBER", "ext:lon": "LIT:NUMBER", "ext:percentage": "LIT:NUMBER",
    "ext:duration": "LIT:DATETIME",
}


@dataclass(frozen=True)
class Vocabulary:
    """One vocabulary's settings. A dense one wants a score for every type, a sparse one reads missing scores as 0."""

    name: str
    types: tuple[str, ...] = ()
    dense: bool = True
    coarse: dict[str, str] | None = None
    aliases: tuple[tuple[str, str], ...] = ()
    prefixes: tuple[tuple[str, str], ...] = ()
    prefilter: bool = False
    supports_text: bool = True
    supports_table: bool = True
    text_intro: str = "Mark the named entities of each text precisely."
    table_intro: str = "Tell the semantic type of each table column."

    def __hash__(self) -> int:
        return hash(self.name)


BUILT_IN = {
    v.name: v
    for v in (
        Vocabulary("coarse", tuple(COARSE)),
        Vocabulary("fine", tuple(FINE_TO_COARSE), coarse=FINE_TO_COARSE),
        Vocabulary("sti", tuple(STI_TO_COARSE), dense=False, coarse=STI_TO_COARSE, prefixes=(("XSD:", "xsd:"), ("EXT:", "ext:")), supports_text=False),
        Vocabulary("dpv", dense=False, prefixes=(("dpv-pd:", "dpv:"),), prefilter=True),
    )
}


@dataclass
class VocabularyTables:
    """Dimension tables, one row a type or setting; all are as small as the vocabularies."""

    config: DataFrame
    types: DataFrame
    coarse: DataFrame
    aliases: DataFrame
    vocabularies: dict[str, Vocabulary] = field(default_factory=dict)


def vocabulary_tables(spark: SparkSession, vocabularies: dict[str, Vocabulary] = BUILT_IN) -> VocabularyTables:
    vs = list(vocabularies.values())
    return VocabularyTables(
        spark.createDataFrame([(v.name, v.dense, v.prefilter, v.supports_text, v.supports_table) for v in vs], "schema string, dense boolean, prefilter boolean, supports_text boolean, supports_table boolean"),
        spark.createDataFrame([(v.name, i, t) for v in vs for i, t in enumerate(v.types)], "schema string, ord int, type_id string"),
        spark.createDataFrame([(v.name, k, c) for v in vs for k, c in (v.coarse or {}).items()], "schema string, type_id string, coarse_type_id string"),
        spark.createDataFrame([(v.name, kind, i, a, b) for v in vs for kind, pairs in (("exact", v.aliases), ("prefix", v.prefixes)) for i, (a, b) in enumerate(pairs)], "schema string, kind string, ord int, old string, new string"),
        dict(vocabularies),
    )


def read_registry(path: str, data_dir: str | None = None) -> dict[str, Vocabulary]:
    """Vocabularies of a registry file (a JSON array of objects), with the built-in ones. Read on the driver: a few rows."""
    found = {k: v for k, v in BUILT_IN.items() if k in ("coarse", "fine")}
    for entry in json.loads(Path(path).read_text()):
        name = entry.get("name")
        if not isinstance(name, str) or not name.strip() or name.strip() in found:
            raise ValueError(f"a vocabulary's name must be a new, non-empty text: {name!r}")
        for key in ("prefilter_types", "supports_text", "supports_table"):
            if entry.get(key) is not None and not isinstance(entry[key], bool):
                raise ValueError(f"{key} must be a boolean")
        dense = entry.get("require_all_scores")
        if not isinstance(dense, bool):
            if entry.get("score_mode", "dense") not in ("dense", "sparse"):
                raise ValueError(f"unknown score_mode: {entry['score_mode']}")
            dense = entry.get("score_mode", "dense") == "dense"
        maps = {}
        for key in ("type_aliases", "type_alias_prefixes", "coarse_mapping"):
            value = entry.get(key) or {}
            if not isinstance(value, dict) or not all(isinstance(x, str) and x.strip() for kv in value.items() for x in kv):
                raise ValueError(f"{key} must map non-empty texts to non-empty texts")
            maps[key] = {k.strip(): v.strip() for k, v in value.items()}
        source = next((entry[k] for k in ("type_source", "data_path", "path") if entry.get(k)), None)
        types = tuple(entry.get("type_ids") or ())
        if not types and source:
            types = tuple(parse_type_ids((Path(data_dir or Path(path).parent) / source).read_text()))
        intro = {f: entry[f].strip() for f in ("text_intro", "table_intro") if isinstance(entry.get(f), str) and entry[f].strip()}
        true = lambda key, default: default if entry.get(key) is None else entry[key]
        found[name.strip()] = Vocabulary(
            name.strip(), types, dense, maps["coarse_mapping"] or None, tuple(maps["type_aliases"].items()), tuple(maps["type_alias_prefixes"].items()),
            true("prefilter_types", False), true("supports_text", True), true("supports_table", True), **intro,
        )
    return found


def parse_type_ids(text: str) -> list[str]:
    """Type ids of a JSON list, or of an object that wraps one; first occurrences, in order."""
    data = json.loads(text)
    if isinstance(data, dict):
        data = next((data[k] for k in ("types", "type_ids", "items", "data") if k in data), [])
    ids = [x if isinstance(x, str) else x.get("id") if isinstance(x, dict) else None for x in data if isinstance(data, list)]
    ids = list(dict.fromkeys(x for x in ids if isinstance(x, str)))
    if not ids:
        raise ValueError("the vocabulary has no type ids")
    return ids


def dedupe_types(types: DataFrame) -> DataFrame:
    """schema, ord, type_id with each type once, at its first place."""
    return types.groupBy("schema", "type_id").agg(F.min("ord").alias("ord")).select("schema", "ord", "type_id")


def coarse_of(types: DataFrame, coarse: DataFrame, coarse_ids: list[str]) -> DataFrame:
    """types with coarse_type_id: itself for a coarse id, else its roll-up, else null."""
    own = F.when(F.col("type_id").isin(coarse_ids), F.col("type_id"))
    known = coarse.select("type_id", F.col("coarse_type_id").alias("__c")).distinct()
    return types.join(known, "type_id", "left").withColumn("coarse_type_id", F.coalesce(own, "__c")).drop("__c")


def pick_label(entry: Column) -> Column:
    """An entry's label: preferred before plain; of several, the English one before the first with a value; null for none."""
    picked = []
    for key in ("http://www.w3.org/2004/02/skos/core#prefLabel", "http://www.w3.org/2000/01/rdf-schema#label"):
        items = F.try_variant_get(entry, f"$['{key}']", "array<variant>")
        items = F.coalesce(items, F.array(F.try_variant_get(entry, f"$['{key}']", "variant")))
        text = lambda x: F.try_variant_get(x, "$['@value']", "string")
        items = F.filter(items, lambda x: text(x).isNotNull())
        english = F.filter(items, lambda x: F.try_variant_get(x, "$['@language']", "string") == "en")
        picked += [text(F.try_element_at(english, F.lit(1))), text(F.try_element_at(items, F.lit(1)))]
    return F.nullif(F.coalesce(*picked), F.lit(""))


def accept_paths(files: DataFrame, version: str = "2.2/") -> DataFrame:
    """Files of one version that hold JSON-LD and aren't ontology exports."""
    return files.where(F.col("path").startswith(version) & F.col("path").endswith(".jsonld") & ~F.col("path").contains("-owl")).dropDuplicates(["path"])


def unusable_files(files: DataFrame) -> DataFrame:
    """path, reason of accepted files that give no entries: ``unparseable``, ``double key`` (valid JSON but for that), or ``no entries`` (neither a list nor a graph)."""
    root, plain = F.try_parse_json("doc"), F.get_json_object("doc", "$")
    listed = F.coalesce(F.try_variant_get(root, "$", "array<variant>"), F.try_variant_get(root, "$['@graph']", "array<variant>"))
    reason = F.when(root.isNull() & plain.isNull(), "unparseable").when(root.isNull(), "double key").when(listed.isNull(), "no entries")
    return accept_paths(files).select("path", reason.alias("reason")).where("reason is not null")


def build_vocabulary(files: DataFrame) -> DataFrame:
    """id, label, iri from JSON-LD files (path, doc); the first entry of an id, by path and place, wins."""
    root = F.try_parse_json("doc")
    listed = F.coalesce(F.try_variant_get(root, "$", "array<variant>"), F.try_variant_get(root, "$['@graph']", "array<variant>"))
    entries = accept_paths(files).select("path", F.posexplode(listed).alias("pos", "entry"))
    found = entries.select("path", "pos", F.try_variant_get("entry", "$['@id']", "string").alias("iri"), F.schema_of_variant(F.try_variant_get("entry", "$['@id']", "variant")).alias("kind"), pick_label(F.col("entry")).alias("label"))
    found = found.where("kind = 'STRING' and label is not null and not startswith(iri, '_:')").withColumn("id", shorten_iri(F.col("iri")))
    first = found.groupBy("id").agg(F.min_by(F.struct("label", "iri"), F.struct("path", "pos")).alias("e"))
    return first.select("id", "e.label", "e.iri")
