"""Duplicate people: same e-mail, or matching names with evidence inside one company.

Every row is directed from the newer record to the older one. Records that all match each other by definition form a
bucket: one e-mail address; one name at one company with one phone, with one local part of the address, or beside a
record without an address. In a bucket every member is linked to the oldest one (of those without an address, in the
last case), so a bucket of n members has n-1 rows at any size.

Different names that match, and alike but different addresses, meet as classes: all records of one name at one company, those
of them with one phone, with one local part of the address, and without an address. An edge joins two classes whose members all
match each other; it has one row, of the oldest member of the older side and the oldest younger one of the other (the newest, if
its oldest is no younger). Members of a class are linked by its bucket, so rows stay linear in the records, and records that
match are always linked over others. `classes`, `memberships` and `class_edges` give the graph, `expand` all pairs of chosen leads.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.config import EMAIL_LOCAL_THRESHOLD
from salesloom.functions.numbers import whole_text
from salesloom.functions.similarity import all_pieces, indel_ratio, may_reach_ratio, one_keystroke, ratio_pieces, reaching_ratio, typo_signatures
from salesloom.functions.text import canonical_first, email_local_key, fold, normalize_company, normalize_email, normalize_phone
from salesloom.sources.storage import written

END_OF_TIME = "9999-12-31 00:00:00"
NAME_KEY = ["block", "first", "last"]
FEW_NAMES = 4_096  # meetings of names of one block that a plain join makes
PERSON = ["block", "lead_id", "age", "first", "last", "first_formal", "last_formal", "email", "phone", "email_key"]


def people(leads: DataFrame) -> DataFrame:
    """Leads reduced to what matching needs; `company_name` and `phone` are optional columns."""
    has = set(leads.columns)
    company_key = normalize_company(F.col("company_name")) if "company_name" in has else F.lit("")
    phone = normalize_phone(F.col("phone")) if "phone" in has else F.lit(None).cast("string")
    by_id = F.concat(F.lit("id:"), F.coalesce(F.col("company_id"), F.lit("None")))
    base = leads.select(
        "lead_id",
        F.struct(F.coalesce(F.col("created_at"), F.lit(END_OF_TIME).cast("timestamp_ntz")).alias("created_at"),
                 F.col("lead_id").alias("id")).alias("age"),
        F.when(company_key != "", company_key).otherwise(by_id).alias("block"),
        fold(F.col("first_name")).alias("first"),
        fold(F.col("last_name")).alias("last"),
        normalize_email(F.col("email")).alias("email"),
        phone.alias("phone"),
    )
    return (base.withColumn("email_key", F.when(F.col("email").isNotNull(), email_local_key(F.col("email"))))
            .withColumn("first_formal", canonical_first(F.col("first")))
            .withColumn("last_formal", canonical_first(F.col("last"))))  # a last name may be a first name in the wrong field


def _agreement(older: str, newer: str, formal: bool = False) -> Column:
    """How far two parts of names agree: 2 equal, 1 a keystroke or (for first names) a nickname apart, 0 neither or one is missing."""
    a, b = F.col(f"{older}_old"), F.col(f"{newer}_new")
    close = one_keystroke(a, b)
    if formal:
        close = close | (F.col(f"{older}_formal_old") == F.col(f"{newer}_formal_new"))
    return F.when(F.least(F.length(a), F.length(b)) == 0, 0).when(a == b, 2).when(close, 1).otherwise(0)


def name_verdict() -> Column:
    """Why the names of an older and a newer record are one person's; NULL where they are not."""
    in_place = F.least(_agreement("first", "first", formal=True), _agreement("last", "last"))
    crossed = F.least(_agreement("first", "last", formal=True), _agreement("last", "first"))
    return F.when(in_place == 2, "same name").when(in_place == 1, "matching name").when(crossed > 0, "swapped first/last name")


def _side(persons: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return persons.select(*[F.col(c).alias(f"{c}_{side}") for c in columns])


def _named(persons: DataFrame) -> DataFrame:
    return persons.filter((F.col("first") != "") & (F.col("last") != ""))


def _keyed(df: DataFrame, keys: Column) -> DataFrame:
    """One row per candidate key, the key being a hash of the block and the key text.

    Size estimates do not see that the rows multiply here, so joins on `key` carry a merge hint: the
    exploded side must never be taken for a small one and broadcast.
    """
    return df.withColumn("key", F.explode(keys)).withColumn("key", F.xxhash64("block", "key"))


# ------------------------------------------------------------------ names

def _with_nickname(name: str) -> Column:
    return F.array_union(typo_signatures(F.col(name)), F.array(F.col(f"{name}_formal")))


def _pairs_of(left: Column, right: Column) -> Column:
    """Every signature of one name combined with every signature of the other, as one array."""
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, F.lit("\x1f"), b))))


def matching_names(persons: DataFrame, younger: DataFrame | None = None) -> DataFrame:
    """(block, first_old, last_old, first_new, last_new, why): distinct names inside a block that match, in both age directions,
    or those of `persons` as the older ones with those of `younger`.

    Records that share one name cost one row here. Names of a small block meet all others of it. In a larger one they meet by keys that
    hold a signature of both names, so that a frequent last name alone joins nothing; only hashes of keys and names are sent there.
    """
    fields = [*NAME_KEY, "first_formal", "last_formal"]
    names = written(_named(persons).select(*fields).distinct(), "names")
    new_names = names if younger is None else written(_named(younger).select(*fields).distinct(), "names")
    met = _all_names(names, new_names).unionByName(_names_by_key(names, new_names))
    met = met.withColumn("why", name_verdict()).filter(F.col("why").isNotNull())
    return met.select(F.col("block_old").alias("block"), "first_old", "last_old", "first_new", "last_new", "why")


def _blocks(names: DataFrame, new_names: DataFrame) -> DataFrame:
    """(block, small): whether all names of a block may meet."""
    sizes = [df.groupBy("block").agg(F.count(F.lit(1)).alias(n)) for df, n in ((names, "n_old"), (new_names, "n_new"))]
    return sizes[0].join(sizes[1], "block").select("block", (F.col("n_old") * F.col("n_new") <= FEW_NAMES).alias("small"))


def _all_names(names: DataFrame, new_names: DataFrame) -> DataFrame:
    """All names of small blocks beside each other."""
    fields, blocks = names.columns, _blocks(names, new_names).filter("small")
    old = _side(names.join(blocks.hint("merge"), "block"), "old", fields)
    return old.join(_side(new_names, "new", fields).hint("merge"), F.col("block_old") == F.col("block_new"))


def _names_by_key(names: DataFrame, new_names: DataFrame) -> DataFrame:
    """Names of large blocks that have a signature of both names in common."""
    fields, blocks, large = names.columns, _blocks(names, new_names), []
    for df in (names, new_names):
        large.append(df.join(blocks.filter("NOT small").hint("merge"), "block").select(*fields, F.xxhash64(*NAME_KEY).alias("id")))
    old_keys = _pairs_of(typo_signatures(F.col("last")), _with_nickname("first"))
    new_keys = F.array_union(old_keys, _pairs_of(typo_signatures(F.col("first")), _with_nickname("last")))
    old, new = (_side(_keyed(df, keys), side, ["key", "id"]) for df, keys, side in ((large[0], old_keys, "old"), (large[1], new_keys, "new")))
    met = old.join(new.hint("merge"), F.col("key_old") == F.col("key_new")).select("id_old", "id_new").distinct()
    sides = [_side(df, side, ["id", *fields]) for df, side in zip(large, ("old", "new"))]
    # Names of one hash all come back, and keys of other blocks may meet: the verdict, asked inside a block only, is on the names themselves.
    both = met.join(sides[0].hint("merge"), "id_old").join(sides[1].hint("merge"), "id_new").filter("block_old = block_new")
    return both.select(*[f"{c}_{side}" for side in ("old", "new") for c in fields]).distinct()


# ------------------------------------------------------------------ classes

CLASS_KEY = [*NAME_KEY, "kind", "value"]
_MEMBER = ["age", "lead_id", "first_formal", "last_formal", "email", "phone", "email_key"]
_SIDE = ["first", "last", "kind", "value", "members", "oldest", "newest"]
FEW_MEETINGS, BLOCK_CLASSES = 256, 512  # meetings of local parts of a pair of names that a plain join makes; classes of a side in a block


def _in_classes(persons: DataFrame, columns: list[Column]) -> DataFrame:
    """A row for each class that a named record is in: of its name, its phone, its address's local part, or those without one."""
    def one(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    has_email = F.col("email").isNotNull()
    kinds = F.array(one("name", F.lit("")), F.when(F.col("phone").isNotNull(), one("phone", F.col("phone"))),
                    F.when(has_email, one("mail", F.col("email_key"))), F.when(~has_email, one("bare", F.lit(""))))
    return _named(persons).select(*NAME_KEY, *columns, F.inline(F.filter(kinds, lambda k: k.isNotNull())))


def classes(persons: DataFrame) -> DataFrame:
    """(block, first, last, kind, value, members, oldest, newest)."""
    each = _in_classes(persons, [F.struct(*_MEMBER).alias("member")])
    return each.groupBy(*CLASS_KEY).agg(F.count(F.lit(1)).alias("members"), F.min("member").alias("oldest"), F.max("member").alias("newest"))


def memberships(leads: DataFrame) -> DataFrame:
    """(lead_id, block, first, last, kind, value)."""
    return _in_classes(people(leads), [F.col("lead_id")])


def _class_key(newer: bool) -> Column:
    """What the classes of both sides of an edge between different names have in common: a phone, or one side without addresses."""
    lacking = "older lacks e-mail" if newer else "newer lacks e-mail"
    bare = "newer lacks e-mail" if newer else "older lacks e-mail"
    return (F.when(F.col("kind") == "phone", F.concat(F.lit("phone "), F.col("value")))
            .when(F.col("kind") == "name", F.lit(lacking)).when(F.col("kind") == "bare", F.lit(bare)))


def _exact_edges(groups: DataFrame, names: DataFrame) -> DataFrame:
    """(block, why, old, new): classes of different names that have a phone in common, or of which one has no addresses."""
    # Records of one name meet by different local parts only; all else links them in buckets.
    different = names.filter(F.col("why") != "same name")
    others, side = groups.filter(F.col("kind") != "mail"), F.struct(*_SIDE)
    old = others.select("block", F.col("first").alias("first_old"), F.col("last").alias("last_old"), side.alias("old"), _class_key(newer=False).alias("key"))
    new = others.select("block", F.col("first").alias("first_new"), F.col("last").alias("last_new"), side.alias("new"), _class_key(newer=True).alias("key"))
    met = old.join(different.hint("merge"), ["block", "first_old", "last_old"]).join(new.hint("merge"), ["block", "first_new", "last_new", "key"])
    return met.select("block", "why", "old", "new")


def _mail_edges(groups: DataFrame, names: DataFrame) -> DataFrame:
    """(block, why, old, new): classes of local parts of matching names whose ratio reaches the threshold.

    Local parts of a pair of names meet all, as their pieces tell little: those of one name begin alike. A few meet in a join; of more,
    each side is dealt over blocks of about `BLOCK_CLASSES`, and only what is alike leaves a block.
    """
    mails = groups.filter((F.col("kind") == "mail") & F.col("value").isNotNull())
    sizes = mails.groupBy(*NAME_KEY).agg(F.count(F.lit(1)).alias("n"))
    pairs = names
    for side in ("old", "new"):
        pairs = pairs.join(sizes.select("block", F.col("first").alias(f"first_{side}"), F.col("last").alias(f"last_{side}"), F.col("n").alias(f"n_{side}")),
                           ["block", f"first_{side}", f"last_{side}"])
    pairs = written(pairs.filter("why <> 'same name' OR n_old > 1"), "name-pairs")

    def side_of(side: str, size: str) -> DataFrame:
        return mails.select("block", F.col("first").alias(f"first_{side}"), F.col("last").alias(f"last_{side}"), F.struct(*_SIDE).alias(side)).join(
            pairs.filter(size).hint("merge"), ["block", f"first_{side}", f"last_{side}"])
    pair = ["block", "first_old", "last_old", "first_new", "last_new", "why"]
    small = f"n_old * n_new <= {FEW_MEETINGS}"
    new = mails.select("block", F.col("first").alias("first_new"), F.col("last").alias("last_new"), F.struct(*_SIDE).alias("new"))
    met = side_of("old", small).join(new.hint("merge"), ["block", "first_new", "last_new"])
    met = met.filter(may_reach_ratio(F.col("old.value"), F.col("new.value"), EMAIL_LOCAL_THRESHOLD)).select("block", "why", "old", "new")

    left, right = (F.ceil(F.col(f"n_{side}") / BLOCK_CLASSES) for side in ("old", "new"))
    older = side_of("old", f"NOT ({small})").select(*pair, F.pmod(F.xxhash64("old.value"), left).alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), right - 1)).alias("j"),
                                                    F.lit(True).alias("older"), F.col("old").alias("side"))
    newer = side_of("new", f"NOT ({small})").select(*pair, F.explode(F.sequence(F.lit(0).cast("bigint"), left - 1)).alias("i"), F.pmod(F.xxhash64("new.value", F.lit(1)), right).alias("j"),
                                                    F.lit(False).alias("older"), F.col("new").alias("side"))
    schema = T.StructType([met.schema[c] for c in ("block", "why", "old", "new")])
    kinds = {"block": pa.string(), "why": pa.string()}

    def meet(key: tuple, part: pa.Table) -> pa.Table:
        side, older = part.column("side").combine_chunks(), part.column("older").to_numpy()
        value = side.field("value").to_pylist()
        x, y = np.nonzero(older)[0], np.nonzero(~older)[0]
        i, j = reaching_ratio([value[k] for k in x], [value[k] for k in y], EMAIL_LOCAL_THRESHOLD)
        same = [pa.array([key[pair.index(c)].as_py()] * len(i), kind) for c, kind in kinds.items()]
        return pa.table([*same, side.take(pa.array(x[i])), side.take(pa.array(y[j]))], ["block", "why", "old", "new"])

    return met.unionByName(older.unionByName(newer).groupBy(*pair, "i", "j").applyInArrow(meet, schema))


def class_edges(groups: DataFrame, names: DataFrame) -> DataFrame:
    """(why, block, and for both sides first, last, kind, value, members, and one member each: old, new) of the edges between `classes`.

    Addresses of an edge between local parts may reach the ratio; whether they do is left to `_with_reason`.
    """
    met = _exact_edges(groups, names).unionByName(_mail_edges(groups, names))
    met = met.filter((F.col("why") != "same name") | (F.col("old.value") != F.col("new.value")))
    younger = F.when(F.col("new.oldest.age") > F.col("old.oldest.age"), F.col("new.oldest")).otherwise(F.col("new.newest"))
    return met.select("why", "block", *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in ("old", "new") for c in ("first", "last", "kind", "value", "members")],
                      F.col("old.oldest").alias("old"), younger.alias("new")).filter(F.col("old.age") < F.col("new.age"))


def _edge_pairs(edges: DataFrame) -> DataFrame:
    both = [F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in ("old", "new") for c in _MEMBER]
    return edges.select(*both, "why", (F.col("kind_old") != "mail").alias("sure"))


# ------------------------------------------------------------------ pairs of records

def _evidence_keys(newer: bool) -> Column:
    """What a record can be matched on beside its name: phone, a missing e-mail on one side, pieces of its e-mail."""
    has_email = F.col("email").isNotNull()
    tags = F.array(
        F.when(F.col("phone").isNotNull(), F.concat(F.lit("phone "), F.col("phone"))),
        F.when(F.lit(newer) | ~has_email, F.lit("older lacks e-mail")),
        F.when(F.lit(not newer) | ~has_email, F.lit("newer lacks e-mail")),
    )
    pieces = ratio_pieces(F.col("email_key")) if newer else all_pieces(F.col("email_key"))
    mail = F.when(has_email, F.transform(pieces, lambda t: F.concat(F.lit("mail "), t)))
    return F.concat(F.filter(tags, lambda t: t.isNotNull()), F.coalesce(mail, F.array().cast("array<string>")))


def _pairs_by_evidence(older: DataFrame, newer: DataFrame, names: DataFrame) -> DataFrame:
    """Records with matching names and a common piece of evidence, joined on both at once; one of the sides is chosen leads."""
    old = _side(_keyed(_named(older), _evidence_keys(newer=False)), "old", ["key", *PERSON])
    new = _side(_keyed(_named(newer), _evidence_keys(newer=True)), "new", ["key", *PERSON])
    named = old.join(names.hint("merge"), (old["block_old"] == names["block"]) & (old["first_old"] == names["first_old"])
                     & (old["last_old"] == names["last_old"])).drop(names["first_old"]).drop(names["last_old"]).drop("block")
    met = named.join(new.hint("merge"), (F.col("block_old") == F.col("block_new")) & (named["first_new"] == new["first_new"])
                     & (named["last_new"] == new["last_new"]) & (F.col("key_old") == F.col("key_new")))
    return met.select(*[f"{c}_{side}" for side in ("old", "new") for c in _MEMBER], "why", F.lit(True).alias("sure"))


def _bucket_links(persons: DataFrame, key: list[str], center: Column) -> DataFrame:
    """Every member of a bucket beside the oldest of those that can be its center."""
    person = F.struct(*_MEMBER)
    centers = persons.filter(center).groupBy(*key).agg(F.min(person).alias("center"))
    met = persons.select(*key, person.alias("member")).join(centers, key).filter("member.lead_id <> center.lead_id")
    older = F.when(F.col("member.age") < F.col("center.age"), F.col("member")).otherwise(F.col("center"))
    newer = F.when(F.col("member.age") < F.col("center.age"), F.col("center")).otherwise(F.col("member"))
    met = met.select(older.alias("o"), newer.alias("n"))
    return met.select(*[F.col(f"o.{c}").alias(f"{c}_old") for c in _MEMBER], *[F.col(f"n.{c}").alias(f"{c}_new") for c in _MEMBER],
                      F.lit("same name").alias("why"), F.lit(True).alias("sure"))


def _with_reason(pairs: DataFrame) -> DataFrame:
    """(lead_id, related_lead_id, reason) of the pairs whose evidence holds, once each; equal addresses are left to their own rule.

    Pairs that are not `sure` meet by their addresses, which have to be alike then."""
    both = F.col("email_old").isNotNull() & F.col("email_new").isNotNull()
    same_email = F.coalesce(F.col("email_old") == F.col("email_new"), F.lit(False))
    same_phone = F.coalesce(F.col("phone_old") == F.col("phone_new"), F.lit(False))
    possible = ~both | same_phone | may_reach_ratio(F.col("email_key_old"), F.col("email_key_new"), EMAIL_LOCAL_THRESHOLD)
    held = pairs.filter((F.col("age_old") < F.col("age_new")) & ~same_email & possible).select(
        F.col("lead_id_new").alias("lead_id"), F.col("lead_id_old").alias("related_lead_id"), "sure",
        F.struct("why", same_phone.alias("same_phone"), (~both).alias("lacks_email"),
                 F.when(both, F.col("email_key_old")).alias("key_a"), F.when(both, F.col("email_key_new")).alias("key_b")).alias("facts"))
    held = held.groupBy("lead_id", "related_lead_id").agg(F.max("sure").alias("sure"), F.min("facts").alias("facts")).select("lead_id", "related_lead_id", "sure", "facts.*")
    held = held.withColumn("ratio", indel_ratio(F.col("key_a"), F.col("key_b")))
    reason = (
        F.when(F.col("ratio") >= EMAIL_LOCAL_THRESHOLD,
               F.concat(F.col("why"), F.lit(" and similar email ("), whole_text(F.col("ratio")), F.lit(") at same company")))
        .when(~F.col("sure"), None)
        .when(F.col("same_phone"), F.concat(F.col("why"), F.lit(" and same phone at same company")))
        .when(F.col("lacks_email"), F.concat(F.col("why"), F.lit(" at same company, email missing on one record")))
    )
    return held.select("lead_id", "related_lead_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def _email_reason() -> Column:
    return F.concat(F.lit("same email ("), F.col("email"), F.lit(")")).alias("reason")


# ------------------------------------------------------------------ results

def email_rows(persons: DataFrame) -> DataFrame:
    """(lead_id, related_lead_id, reason): every record of an address beside the oldest one."""
    addressed = persons.filter(F.col("email").isNotNull())
    oldest = addressed.groupBy("email").agg(F.min("age").alias("oldest"))
    return (addressed.join(oldest, "email").filter(F.col("age") > F.col("oldest"))
            .select("lead_id", F.col("oldest.id").alias("related_lead_id"), _email_reason()))


def name_rows(persons: DataFrame, groups: DataFrame, names: DataFrame) -> DataFrame:
    """(lead_id, related_lead_id, reason): the buckets of the names of `persons`, and the edges between `groups` over `names`."""
    named = _named(persons)
    with_address = F.col("email").isNotNull()
    links = [
        _bucket_links(named.filter(F.col("phone").isNotNull()), [*NAME_KEY, "phone"], F.lit(True)),
        _bucket_links(named.filter(with_address), [*NAME_KEY, "email_key"], F.lit(True)),
        _bucket_links(named, NAME_KEY, ~with_address),
        _edge_pairs(class_edges(groups, names)),
    ]
    pairs = links[0]
    for more in links[1:]:
        pairs = pairs.unionByName(more)
    return _with_reason(pairs)


def find_duplicates(leads: DataFrame) -> DataFrame:
    """(lead_id newer, related_lead_id older, reason) of `leads(lead_id, company_id, first_name, last_name, email, created_at[, company_name, phone])`."""
    persons = written(people(leads), "people")  # read by every rule below; the normalizers run once
    return email_rows(persons).unionByName(name_rows(persons, written(classes(persons), "classes"), written(matching_names(persons), "matches")))


def duplicate_edges(leads: DataFrame) -> DataFrame:
    """The verified edges between classes of `leads`: what joins them, how many records are on both sides, and the pair that stands for them."""
    persons = written(people(leads), "people")
    edges = class_edges(written(classes(persons), "classes"), written(matching_names(persons), "matches"))
    mail = F.col("kind_old") == "mail"
    rated = edges.withColumn("ratio", indel_ratio(F.when(mail, F.col("value_old")), F.when(mail, F.col("value_new"))))
    return rated.filter(~mail | (F.col("ratio") >= EMAIL_LOCAL_THRESHOLD)).select(
        "why", "block", "first_old", "last_old", "kind_old", "value_old", "members_old", "first_new", "last_new", "kind_new", "value_new", "members_new",
        F.col("old.lead_id").alias("related_lead_id"), F.col("new.lead_id").alias("lead_id"))


def expand(leads: DataFrame, chosen: DataFrame) -> DataFrame:
    """All duplicate pairs, those inside buckets too, in which a `chosen(lead_id)` lead takes part.

    Output grows with the chosen leads times their groups, never with a whole group squared.
    """
    persons = written(people(leads), "people")
    asked = persons.join(chosen.select("lead_id").distinct(), "lead_id", "left_semi")
    ours, others = asked.select("email", F.col("age").alias("mine")), persons.select("email", "age")
    met = ours.join(others, "email").filter(F.col("mine") != F.col("age"))
    by_email = met.select(F.greatest("mine", "age")["id"].alias("lead_id"), F.least("mine", "age")["id"].alias("related_lead_id"), _email_reason())
    names = written(matching_names(persons), "names")
    pairs = _pairs_by_evidence(asked, persons, names).unionByName(_pairs_by_evidence(persons, asked, names))
    return by_email.distinct().unionByName(_with_reason(pairs))
