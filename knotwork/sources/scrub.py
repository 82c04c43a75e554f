"""Scrubbing of properties: preserve, pseudonymise, redact or shift, the first rule that fits.

All built-in functions: a keyed digest is two SHA-256 over padded keys, so equal values get equal
pseudonyms everywhere and none can be traced without the salt.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.types import as_json, json_text, of_spark
from knotwork.graph import PropertyGraph, Source

#: Patterns and layouts of texts.
SHAPES = {
    "email": r"(?i)^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$",
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "domain_sid": r"^S-1-5-21-\d+-\d+-\d+$",
    "object_sid": r"^(S-1-5-21-\d+-\d+-\d+)-(\d+)$",
    "ipv4": r"^(\d{1,3}\.){3}\d{1,3}$",
    "host": r"(?i)^[a-z0-9][a-z0-9-]*(\.[a-z0-9][a-z0-9-]*)+$",
}


@dataclass(frozen=True)
class Rules:
    """What to do with which key; the defaults are fixed values. Keys are compared in lower case without -, _ and spaces; patterns are looked for anywhere in them."""

    salt: str
    domain: str = "example.invalid"
    shift_days: int = 17
    marker: str = "[REDACTED]"
    long_text: int = 512
    reference: tuple[str, ...] = ("domainsid", "objectid", "sid", "ownersid", "primarygroupid", "objectsid", "domain", "domainname")
    preserve: tuple[str, ...] = ("objectid", "domainsid", "kind")
    timestamp: str = r"time|date|created|updated|deleted|modified|seenat$"
    free_text: str = r"description|comment|note|^info$"
    path_or_script: str = r"path|directory|homedir|folder|script"
    secret: str = r"password|secret|token|privatekey|credential|apikey"
    sensitive: str = r"password|secret|token|credential|privatekey|apikey|email|mail|phone|address|name|dns"
    organisation: tuple[str, ...] = ("title", "department", "division", "company", "organization", "office", "location")
    #: Objects within objects are scrubbed so deep; what lies deeper is redacted.
    depth: int = 1

    @classmethod
    def of(cls, settings: dict) -> Rules:
        """Rules from a dictionary, such as a parsed file; an unknown setting is an error."""
        known = {f.name for f in fields(cls)}
        if more := set(settings) - known:
            raise ValueError(f"unknown settings {sorted(more)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})


def normalised(key: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(key)), "[-_ ]", "")


def keyed_digest(text: Column, salt: str) -> Column:
    """HMAC-SHA-256 in hex."""
    import hashlib

    key = salt.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "utf-8")), 256))), 256)


def _int(hex_: Column) -> Column:
    return F.conv(hex_, 16, 10).cast("long")


def _sid(d: Column) -> Column:
    nine = [F.lpad((_int(F.substring(d, at, 8)) % 1_000_000_000).cast("string"), 9, "0") for at in (1, 9, 17)]
    return F.concat_ws("-", F.lit("S-1-5-21"), *nine)


def _let(value: Column, body) -> Column:
    """body of a value that is worked out, and stands in the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pseudonym(value: Column, rules: Rules) -> Column:
    """A text of the same shape; blank stays blank."""
    t = F.trim(value)
    sid = F.regexp_extract(t, SHAPES["object_sid"], 1)

    def by(d: Column) -> Column:
        sub = lambda a, n: F.substring(d, a, n)
        return (
            F.when(t == "", value)
            .when(t.rlike(SHAPES["email"]), F.concat(F.lit("user-"), sub(1, 12), F.lit(f"@{rules.domain}")))
            .when(t.rlike(SHAPES["uuid"]), F.concat_ws("-", sub(1, 8), sub(9, 4), sub(13, 4), sub(17, 4), sub(21, 12)))
            .when(t.rlike(SHAPES["domain_sid"]), _sid(d))
            .when(sid != "", F.concat_ws("-", _sid(d), F.regexp_extract(t, SHAPES["object_sid"], 2)))
            .when(t.rlike(SHAPES["ipv4"]), F.concat_ws(".", F.lit("10"), *[_int(sub(a, 2)).cast("string") for a in (1, 3, 5)]))
            .when(t.rlike(SHAPES["host"]), F.concat(F.lit("host-"), sub(1, 12), F.lit(f".{rules.domain}")))
            .otherwise(F.concat(F.lit("value-"), sub(1, 16)))
        )

    # An object's SID keeps its last part; the digest is that of the domain's.
    return _let(keyed_digest(F.when(sid != "", sid).otherwise(t), rules.salt), by)


def action(key: Column, fragment: Column, rules: Rules) -> Column:
    """preserve, pseudonymize, redact or shift_timestamp for a key and a JSON fragment."""
    k = normalised(key)
    is_text, is_list = fragment.startswith('"'), fragment.startswith("[")
    text = json_text(fragment)
    blank = is_text & (F.trim(text) == "")
    items = F.from_json(fragment, "array<string>")
    texts = (is_text & ~blank) | (is_list & fragment.contains('"') & F.coalesce(F.exists(items, lambda x: F.trim(x) != ""), F.lit(False)))
    long = (is_text & (F.octet_length(text) > rules.long_text)) | (is_list & F.coalesce(F.exists(items, lambda x: F.octet_length(x) > rules.long_text), F.lit(False)))
    any_shape = "|".join(f"(?:{p})" for p in SHAPES.values())
    shaped = (is_text & F.trim(text).rlike(any_shape)) | (is_list & F.coalesce(F.exists(items, lambda x: F.trim(x).rlike(any_shape)), F.lit(False)))
    return (
        F.when(k.isin(*rules.reference) & texts, "pseudonymize")
        .when(k.isin(*rules.preserve), "preserve")
        .when(k.rlike(rules.timestamp), "shift_timestamp")
        .when(k.rlike(rules.free_text), "redact")
        .when(k.rlike(rules.path_or_script), "pseudonymize")
        .when(k.rlike(rules.secret) | long, "redact")
        .when(shaped | k.rlike(rules.sensitive) | k.isin(*rules.organisation) | texts, "pseudonymize")
        .otherwise("preserve")
    )


def _quote(text: Column) -> Column:
    j = F.to_json(F.array(text))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _each(fragment: Column, one) -> Column:
    """A function of texts on a text, on each item of a list, and on no other fragment."""
    is_text = fragment.startswith('"')
    items = F.when(is_text, F.array(json_text(fragment))).otherwise(F.from_json(fragment, "array<string>"))
    joined = F.array_join(F.transform(items, lambda x: _quote(one(x))), ",")
    return F.when(is_text, joined).when(fragment.startswith("[") & fragment.contains('"'), F.concat(F.lit("["), joined, F.lit("]"))).otherwise(fragment)


def _moved(text: Column, rules: Rules) -> Column:
    """A moment that many days later; null for other texts."""
    moment = text.try_cast("timestamp")
    is_moment = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$") & moment.isNotNull()
    new = F.date_format(F.to_utc_timestamp(moment + F.expr(f"interval {rules.shift_days} days"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(is_moment, F.concat(F.regexp_replace(new, r"\.?0+$", ""), F.lit("Z")))


def _inside(fragment: Column, rules: Rules, depth: int) -> Column:
    """A JSON object, or a list of such, with each property scrubbed by its own key."""
    if depth <= 0:
        return _quote(F.lit(rules.marker))

    def one(text: Column) -> Column:
        bag = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
        pairs = F.transform(F.map_entries(bag), lambda e: F.struct(e["key"].alias("k"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("v")))
        parts = F.transform(pairs, lambda e: F.concat(_quote(e["k"]), F.lit(":"), F.when(e["v"] == "null", e["v"]).otherwise(scrubbed(e["k"], e["v"], rules, depth - 1))))
        return F.coalesce(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")), _quote(F.lit(rules.marker)))

    # An object is gone into as a list of one, so that the rules stand in the plan once for each depth.
    found = F.transform(F.try_variant_get(F.try_parse_json(fragment), "$", "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))
    items = F.when(fragment.startswith("{"), F.array(fragment)).otherwise(found)
    parts = F.array_join(F.transform(items, lambda x: F.when(x.startswith("{"), one(x)).otherwise(_quote(F.lit(rules.marker)))), ",")
    return F.coalesce(F.when(fragment.startswith("{"), parts).otherwise(F.concat(F.lit("["), parts, F.lit("]"))), _quote(F.lit(rules.marker)))


def scrubbed(key: Column, fragment: Column, rules: Rules, depth: int | None = None) -> Column:
    """The fragment as the rules leave it. Objects, and lists that hold objects, are gone into unless their key is preserved or redacted."""
    depth = rules.depth if depth is None else depth
    seconds = (fragment.try_cast("decimal(38,6)") + F.lit(rules.shift_days * 86400)).cast("string")
    shifted = F.when(fragment.contains("."), F.regexp_replace(F.regexp_replace(seconds, "0+$", ""), r"\.$", "")).otherwise(F.regexp_replace(seconds, r"\..*$", ""))
    redacted = F.when(fragment.startswith("["), F.concat(F.lit("["), F.array_join(F.transform(F.from_json(fragment, "array<string>"), lambda _: _quote(F.lit(rules.marker))), ","), F.lit("]"))).otherwise(_quote(F.lit(rules.marker)))
    nested = fragment.startswith("{") | (fragment.startswith("[") & fragment.contains("{") & fragment.rlike(r"^\[\s*\{|\}\s*\]$"))
    preserved = normalised(key).isin(*rules.preserve)

    def by(a: Column) -> Column:
        shift = a == "shift_timestamp"
        text = lambda t: F.coalesce(F.when(shift, _moved(t, rules)), pseudonym(t, rules))
        return F.when(a == "redact", redacted).when(nested, F.when(preserved, fragment).otherwise(_inside(fragment, rules, depth))).when(a == "preserve", fragment).when(shift & fragment.rlike("^-?[0-9]"), shifted).otherwise(_each(fragment, text))

    return _let(action(key, fragment, rules), by)


def scrub_map(bag: Column, rules: Rules) -> Column:
    return F.transform_values(bag, lambda k, v: F.when(v == "null", v).otherwise(scrubbed(k, v, rules)))


def _bag(s: Source) -> Column:
    """A source's properties as a map of JSON fragments."""
    if s.bag:
        return F.col(f"`{s.bag}`")
    pairs = [F.struct(F.lit(k).alias("key"), as_json(F.col(f"`{c}`"), of_spark(s.df.schema[c].dataType)).alias("value")) for k, c in s.props.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")


def scrub(graph: PropertyGraph, rules: Rules) -> PropertyGraph:
    """The graph with all properties scrubbed, as property bags. Ids and kinds stay."""
    def one(s: Source) -> Source:
        fixed = [c for c in s.df.columns if c != s.bag and c not in s.props.values()]
        return Source(s.df.select(*fixed, scrub_map(_bag(s), rules).alias("props")), {}, s.static, "props")

    return PropertyGraph(graph.spark, [one(s) for s in graph.nodes], [one(s) for s in graph.edges])


def action_counts(graph: PropertyGraph, rules: Rules) -> DataFrame:
    """(element, action, count): how many properties of nodes and edges each action is for."""
    out = None
    for element, sources in (("node", graph.nodes), ("edge", graph.edges)):
        for s in sources:
            each = s.df.select(F.explode(_bag(s)).alias("k", "v")).where("v <> 'null'").select(F.lit(element).alias("element"), action(F.col("k"), F.col("v"), rules).alias("action"))
            out = each if out is None else out.unionByName(each)
    return out.groupBy("element", "action").agg(F.count("*").alias("count")) if out is not None else graph.spark.createDataFrame([], "element string, action string, count long")


def metadata(rules: Rules) -> dict:
    """What a dump's manifest says of its scrubbing; the salt only as a digest."""
    import hashlib

    return {"scrubbed": True, "salt_sha256": hashlib.sha256(rules.salt.encode()).hexdigest(), **{f.name: getattr(rules, f.name) for f in fields(rules) if f.name != "salt"}}
