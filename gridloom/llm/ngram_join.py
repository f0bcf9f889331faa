"""N-gram Jaccard join with token-combination prefixes.

Two texts link when the Jaccard similarity of their sets of word n-grams reaches a threshold. The
join returns the connected components of all links, exactly, without listing all pairs of a group.

1. Equal sets collapse to one class (the least id stands for it).
2. Every class lists the tokens (n-gram hashes) below a fixed hash horizon. A token that no other class
   lists is a miss with whoever it might link: classes with more of them than a link allows are done. The
   others list half of their tokens and then all, and those with too many that no other of them has are done too.
3. The rest knows the frequency of each shared token. They order as: rare, by frequency; frequent, by
   group. In that order prefixes are extended until their signatures outlast any allowed number of
   misses: a rare token is a signature by itself; frequent tokens are dealt into groups by their hash, the
   number of groups following the size band, and every pair of tokens of a group is one (g tokens of a
   group need g - 1 misses before all their pairs are gone). Texts near the lower end of a size band also
   sign in the band below.
4. Each signature's group is tested as a star: a leader, the same for most groups of a family, against
   each member. What a star leaves open of a small group (at most `rare` classes) is tested pair by pair.
5. A large group (near copies of one text, say) goes on with differences. Let D be a member's symmetric
   difference with the leader L. For members a and b, |a diff b| = |D_a| + |D_b| - 2 |D_a and D_b|. If a is
   not linked with L, |D_a| alone is too large for a link, so a and b link only if they share more than
   half of D_b; and pairs that are both linked with L need no test. So what is left of a group are pairs that
   share a token in prefixes of their differences, in the order: what no other class has (such tokens need no
   listing), what else L lacks, what the member lacks. They are dealt anew by such tokens, and so on, with
   four times as many leaders a group each round. Leaders are done with their groups, so the rounds end.

Nulls, empty texts and texts without words have no set and are their own component. Rows with the
same id count as one document each; they share a component if their sets link. Extra columns are
ignored. A null id keeps its row and its set size; it takes the component of an equal set, else null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.shingles import ODD, TAIL, U, fingerprint, mix, shingle_sets
from gridloom.session import fewer, numbered, staged, stored, unstaged

RARE = 32
SINGLES_ONLY = 5  # bands of sets under 2 ** 5 tokens have no pair signatures
GROUP = 24
ROWS = 256
SALTED = 1024  # members of a group that read one copy of the leader's set
MARGIN = 0.05  # of all tokens, listed beyond the share that a link may miss


def misses(n: int, num: int, den: int) -> int:
    """How many of n tokens a linked partner may lack."""
    return n - -(-n * num // den)


def _need(n: Column, num: int, den: int) -> Column:
    """misses() + 1 of a column."""
    return n + 1 - ((n * num + (den - 1)) / den).cast("long")


def groups_of(band: int) -> int:
    """Number of groups of frequent tokens in a size band; 0: single tokens only."""
    return max(1, (1 << band) // GROUP) if band >= SINGLES_ONLY else 0


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)))


def _numbers(cell) -> np.ndarray:
    return cell.values.to_numpy().view(U)


def _list_tokens(width: int, num: int, den: int):
    """Size and fingerprint of each text's set, and its tokens below the horizon."""
    horizon = U(min(int(min(1.0, 1 - num / den + MARGIN) * 2.0**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, len(whole), ROWS)):
            sizes, ones, twos, listed = [], [], [], []
            for s in shingle_sets(batch.column("text"), width):
                one, two = fingerprint(s)
                sizes.append(len(s)), ones.append(one), twos.append(two)
                listed.append(s[: int(np.searchsorted(s, horizon))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), _lists(listed)],
                ["doc_id", "n", "one", "two", "tokens"],
            )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, and its text packed, for the way through a shuffle."""
    codec = pa.Codec("zstd", 3)
    for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, len(whole), ROWS)):
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], ["doc_id", "bytes", "packed"])


def _sets(width: int):
    """The whole sets of classes, from packed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for part in (whole.slice(a, ROWS) for whole in batches for a in range(0, len(whole), ROWS)):
            names, sets = [], []
            known = zip(part.column("class").to_pylist(), part.column("one").to_pylist(), part.column("two").to_pylist())
            texts = [codec.decompress(x, n, asbytes=True).decode() for x, n in zip(part.column("packed").to_pylist(), part.column("bytes").to_pylist())]
            for s, (name, one, two) in zip(shingle_sets(pa.array(texts, pa.string()), width), known):
                if fingerprint(s) == (one, two):  # one id may stand for several texts
                    names.append(name), sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["class", "n", "tokens"])

    return run


def signatures(n: int, tokens: np.ndarray, df: np.ndarray, num: int, den: int, rare_df: int = RARE) -> np.ndarray:
    """Signatures of one set of n tokens, from those that others have too and their frequencies."""
    need = misses(n, num, den) + 1 - (n - len(tokens))
    if need <= 0:
        return tokens[:0]
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    band = n.bit_length() - 1
    bands = [band] + [band - 1] * (-(-n * num // den) < 1 << band)
    out = []
    for b in bands:
        tag, count = mix(np.array([b], U) + TAIL), groups_of(b)
        rare = tokens[df <= rare_df][:need] if count else tokens[:need]
        out.append(mix(rare ^ tag))
        left = need - len(rare)
        often = np.sort(tokens[df > rare_df]) if count else tokens[:0]
        if left > 0 and len(often):
            group = (mix(often) % U(count)).astype(np.int64)
            for g in np.unique(group):
                own = often[group == g][: left + 1]
                i, j = np.triu_indices(len(own), 1)
                out.append(mix(mix(own[i] ^ tag) * ODD + own[j]))
                left -= len(own) - 1
                if left <= 0:
                    break
        if left > 0:  # pairs run out before the misses do
            out.append(mix(often ^ tag))
    return np.unique(np.concatenate(out))


def _sign(num: int, den: int, rare_df: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, len(whole), ROWS)):
            sizes, signs = batch.column("n").to_pylist(), []
            for n, own in zip(sizes, batch.column("shared")):
                signs.append(signatures(n, own.values.field("token").to_numpy().view(U), own.values.field("df").to_numpy(), num, den, rare_df))
            counts = [len(x) for x in signs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(signs).view(np.int64) if signs else np.zeros(0, np.int64)), pa.array(np.repeat(batch.column("class").to_numpy(), counts)), pa.array(np.repeat(batch.column("n").to_numpy(), counts))],
                ["key", "class", "n"],
            )

    return run


def common_tokens(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of y's tokens are in x; both sorted, x not empty."""
    return x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y


def difference(x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> tuple[int, np.ndarray]:
    """y's symmetric difference with x: how many of its tokens only y has, and these first, then what
    else x lacks, then what y lacks."""
    more = y[~common_tokens(x, y)]
    alone = ~common_tokens(shared, more) if len(shared) else np.ones(len(more), bool)
    return int(alone.sum()), np.concatenate([more[alone], more[~alone], x[~common_tokens(y, x)]])


def prefixes(d: int, n: int, n_leader: int, linked: bool, num: int, den: int) -> tuple[int, int]:
    """How many of d difference tokens of a member (size n) must be listed, and how many of these
    against other unlinked members. See point 5 above: a pair with an unlinked member shares more than
    (d - c max(0, n - n_leader)) / 2 of them, c = (den - num) / (den + num); and an unlinked member
    shares all but (den - num) / num n."""
    half = d - (d * (den + num) - (den - num) * max(0, n - n_leader)) // (2 * (den + num))
    if linked:
        return half, 0
    most = min(d, (den - num) * n // num + 1)
    return most, min(half, most)


def _test(num: int, den: int):
    """Whether leader and member link; if they are asked for, the listed tokens of their difference,
    without those that only the member has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, size, close, rest = [], [], [], []
            for x, y, s, ask in zip(batch.column("leader_set"), batch.column("member_set"), batch.column("member_shared"), batch.column("ask").to_pylist()):
                x, y = _numbers(x), _numbers(y)
                common = int(common_tokens(x, y).sum())
                linked.append(den * common >= num * (len(x) + len(y) - common))
                if ask:
                    alone, d = difference(x, y, np.sort(_numbers(s)))
                    listed, among = prefixes(len(d), len(y), len(x), linked[-1], num, den)
                    size.append(len(d)), close.append(max(0, among - alone)), rest.append(d[alone:listed])
                else:
                    size.append(0), close.append(0), rest.append(np.zeros(0, U))
            yield pa.RecordBatch.from_arrays(
                [batch.column("leader"), batch.column("member"), batch.column("n"), pa.array(linked, pa.bool_()), pa.array(size, pa.int64()), pa.array(close, pa.int32()), _lists(rest)],
                ["leader", "member", "n", "linked", "d", "close", "rest"],
            )

    return run


def _tested(pairs: DataFrame, sets: DataFrame, num: int, den: int, size: int) -> DataFrame:
    """pairs(leader, member, n of the member, salt, ask) with the verdict on each. The leader's set is
    copied once a salt, so no task reads all members of a large group. size: bytes that the pairs come from."""
    pairs = staged(fewer(pairs, size), "pairs")
    size = stored(sets) + 64 * stored(pairs)  # a pair brings its sets
    member = pairs.join(sets.select(F.col("class").alias("member"), F.col("tokens").alias("member_set"), F.col("shared").alias("member_shared")), "member")
    member = member.withColumn("member_shared", F.when(F.col("ask"), F.col("member_shared")).otherwise(F.array().cast("array<long>")))
    leader = fewer(pairs.select("leader", "salt").distinct(), size).join(sets.select(F.col("class").alias("leader"), F.col("tokens").alias("leader_set")), "leader")
    both = fewer(fewer(member, size).join(fewer(leader, size), ["leader", "salt"]), size)
    out = staged(both.mapInArrow(_test(num, den), "leader long, member long, n long, linked boolean, d long, close int, rest array<long>"), "tested")
    unstaged(pairs)
    return out


def _open_groups(rows: DataFrame, labels: DataFrame | None, size: int) -> DataFrame:
    """The rows of keys in which pairs are open, with label, weight, group size and leader. The leader has
    most rows for its size: a text whose copies were edited lacks what is special to each. size: bytes of what rows come from."""
    about = rows.groupBy("class").agg((F.count("*") / F.max("n")).alias("weight"))
    if labels is None:
        about = about.withColumn("label", F.col("class"))
    else:
        about = about.join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "weight", F.coalesce("component", "class").alias("label"))
    rows = staged(fewer(rows.join(about, "class"), 2 * size), "labelled")
    size = 2 * stored(rows)
    groups = (
        rows.groupBy("key")
        .agg(F.max(F.struct("weight", (-F.col("class")).alias("back"))).alias("first"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"), F.count_if("linked").alias("with_leader"), F.count_if("close").alias("near"))
        .where("low <> high AND (with_leader > 0 AND with_leader < members OR near > 1)")
        .select("key", (-F.col("first.back")).alias("leader"), "members")
    )
    out = staged(fewer(rows.join(groups, "key"), size), "groups")
    unstaged(rows)
    return out


def _stars(groups: DataFrame, rare: int, leaders: int, size: int) -> DataFrame:
    """Visits of members to leaders. A group has one leader for each of `leaders` parts, dealt by hash."""
    salt = F.pmod(F.xxhash64("class"), F.ceil(F.col("members") / SALTED)).cast("int")
    ask = F.col("members") > rare
    rows = groups.withColumn("salt", salt)
    if leaders == 1:
        visits = rows.select("leader", F.col("class").alias("member"), "n", "salt", ask.alias("ask"))
    else:
        part = F.pmod(F.xxhash64("class", F.lit(leaders)), F.lit(leaders))
        heads = groups.groupBy("key", part.alias("part")).agg(F.max(F.struct("weight", (-F.col("class")).alias("back"))).alias("head")).select("key", (-F.col("head.back")).alias("head"))
        own = heads.select("key", F.col("head").alias("class"), F.lit(True).alias("heads"))
        rows = fewer(fewer(rows.join(fewer(own, size), ["key", "class"], "left"), size).join(heads, "key"), 2 * size)
        visits = rows.select(F.col("head").alias("leader"), F.col("class").alias("member"), "n", "salt", (ask & (F.col("head") == F.col("leader")) & F.col("heads").isNull()).alias("ask"))
    return visits.where("leader <> member").groupBy("leader", "member").agg(F.max("n").alias("n"), F.max("salt").alias("salt"), F.max("ask").alias("ask"))


def _pairs(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of small groups, smaller set first, that may link: labels differ, sizes and differences with a
    former leader allow it, and at least one is not linked with that leader."""
    left = groups.select("key", F.col("class").alias("leader"), F.col("n").alias("leader_n"), F.col("label").alias("leader_label"), F.col("linked").alias("leader_linked"), F.col("close").alias("leader_close"), F.col("d").alias("leader_d"))
    shared = 2 * F.least("d", "leader_d")
    return (
        left.join(groups.select("key", F.col("class").alias("member"), "n", "label", "linked", "close", "d"), "key")
        .where("label <> leader_label AND (n > leader_n OR n = leader_n AND member > leader)")
        .where(F.col("leader_n") * den >= F.col("n") * num)
        .where("linked <> leader_linked OR close AND leader_close")
        .where((F.col("d") + F.col("leader_d") - shared) * (den + num) <= (den - num) * (F.col("n") + F.col("leader_n")))
        .select("leader", "member", "n", F.lit(0).alias("salt"), F.lit(False).alias("ask"))
        .distinct()
    )


def link_classes(rows: DataFrame, sets: DataFrame, num: int, den: int, rare: int, size: int = 0) -> DataFrame | None:
    """Labels (node, component) of the classes that link; rows(key, class, n) are their signatures, from a table of `size` bytes."""
    labels, leaders, old = None, 1, []
    rows = rows.select("key", "class", "n", F.lit(False).alias("linked"), F.lit(True).alias("close"), F.lit(0).cast("long").alias("d"))
    while True:
        groups = _open_groups(rows, labels, size)
        size = stored(groups)
        small, large = groups.agg(F.count_if(F.col("members") <= rare), F.count_if(F.col("members") > rare)).first()
        unstaged(*old)
        if not small + large:
            unstaged(groups)
            return labels
        first, crowded, few = labels is None, groups.where(F.col("members") > rare), groups.where(F.col("members") <= rare)
        tested = []
        if first or large:
            tested.append(_tested(_stars(groups if first else crowded, rare, leaders, size), sets, num, den, size))
        if small and not first:
            tested.append(_tested(fewer(_pairs(few, num, den), 4 * size), sets, num, den, 4 * size))
        links = [t.where("linked").select(F.col("leader").alias("a"), F.col("member").alias("b")) for t in tested]
        if labels is not None:
            links.append(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        new = links[0]
        for more in links[1:]:
            new = new.union(more)
        before, labels = labels, components(new, size=stored(*tested, labels))
        old = [*tested, groups, before]
        if not large and not first:
            unstaged(*old)
            return labels
        listed = tested[0].where(F.size("rest") > 0).select("leader", F.col("member").alias("class"), "n", "linked", "d", F.col("close").alias("among"), F.posexplode("rest").alias("place", "token"))
        rows = listed.select(F.xxhash64("leader", "token").alias("key"), "class", "n", "linked", (F.col("place") < F.col("among")).alias("close"), "d")
        if first:
            rows = rows.unionByName(few.select("key", "class", "n", "linked", "close", "d"))
        size = 4 * stored(tested[0]) + (stored(groups) if first else 0)
        leaders *= 4


def _shared(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of sets(class, n, tokens), which are staged and go: the classes that may link with another, with the tokens that two of them
    have and their frequencies as `shared`, staged."""
    alone = _alone(sets, F.filter("tokens", lambda t: t >= 0) if 1 - num / den + MARGIN < 0.5 else F.col("tokens"))
    kept = sets.join(alone, "class", "left").where(F.coalesce("alone", F.lit(0)) < _need(F.col("n"), num, den)).drop("alone")
    kept = staged(fewer(kept, stored(sets)), "kept")
    unstaged(sets)
    size = 2 * stored(kept)
    tokens = kept.select("class", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    met = fewer(tokens.join(often, "token"), size).groupBy("class").agg(F.collect_list(F.struct("token", "df")).alias("shared"))
    met = met.join(kept, "class").where(F.col("n") - F.size("shared") < _need(F.col("n"), num, den))
    out = staged(fewer(met, size), "shared")
    unstaged(kept)
    return out


def _alone(classes: DataFrame, tokens: Column) -> DataFrame:
    """Of (class, tokens): how many of its tokens no other class has; classes without such tokens are not listed."""
    tokens = classes.select("class", F.explode(tokens).alias("token"))
    once = tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("class").alias("class")).where("c = 1")
    return fewer(once, stored(classes)).groupBy("class").agg(F.count("*").alias("alone"))


def ngram_join(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, rare: int = RARE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Links: Jaccard similarity of the sets of `width`-word shingles of at least num / den (from 1/2 on).
    rare: tokens in more documents sign in pairs, and what is open of larger groups is dealt by differences."""
    if not 2 * num >= den or num > den:
        raise ValueError("the threshold must be between 1/2 and 1")
    same = ["n", "one", "two"]
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    listed = staged(docs.mapInArrow(_list_tokens(width, num, den), "doc_id long, n long, one long, two long, tokens array<long>"), "listed")
    with_set = listed.where("n > 0 AND doc_id IS NOT NULL")
    size = stored(listed)
    repeated = bool(fewer(with_set.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1"), size).limit(1).count())

    classes = with_set.groupBy(*same).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.any_value("tokens").alias("tokens"))
    if repeated:  # one id may stand for several sets
        turn = F.row_number().over(Window.partitionBy("class_id").orderBy(*same))
        classes = classes.withColumn("class", F.when(turn == 1, F.col("class_id")).otherwise(F.xxhash64("class_id", *same)))
    else:
        classes = classes.withColumn("class", F.col("class_id"))
    whole = staged(fewer(classes, size), "listed-classes")
    few = whole.drop("tokens").join(_alone(whole, F.col("tokens")), "class", "left").where(F.coalesce("alone", F.lit(0)) < _need(F.col("n"), num, den))
    few = staged(fewer(few.select("class", F.col("class_id").alias("doc_id"), "one", "two"), size), "few")
    # from here on the lists are not read, only whose they are
    classes, every = staged(whole.drop("tokens"), "classes"), listed
    listed = staged(every.select("doc_id", *same), "sizes")
    unstaged(whole, every)

    texts = docs.where("doc_id IS NOT NULL").mapInArrow(_packed, "doc_id long, bytes long, packed binary")
    found = texts.join(few, "doc_id").mapInArrow(_sets(width), "class long, n long, tokens array<long>")
    whole = staged(found.dropDuplicates(["class"]) if repeated else found, "sets")
    known = _shared(whole, num, den)
    unstaged(few)
    rows = staged(known.select("class", "n", "shared").mapInArrow(_sign(num, den, rare), "key long, class long, n long"), "signatures")
    size = stored(rows)
    met = rows.join(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key", "left_semi")
    known_sets = known.select("class", "tokens", F.transform("shared", lambda s: s["token"]).alias("shared"))
    known_sets.staged_at = known.staged_at
    labels = link_classes(fewer(met, size), known_sets, num, den, rare, size)
    unstaged(rows, known)
    if labels is None:
        found = classes.withColumn("component_id", F.col("class_id"))
    else:
        size = stored(classes, labels)
        linked = fewer(labels.withColumnRenamed("node", "class").join(classes.select("class", "class_id"), "class"), size)
        least = linked.groupBy("component").agg(F.min("class_id").alias("least"))
        found = classes.join(fewer(linked.join(least, "component"), size).select("class", "least"), "class", "left").withColumn("component_id", F.coalesce("least", "class_id"))
    found = staged(fewer(found.where("copies > 1 OR component_id <> class_id").select(*same, "component_id"), stored(classes, labels)), "found")
    unstaged(classes, labels)
    return listed.select("doc_id", *same).join(found, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def unlinked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs of which one stays for each component: that of least id (null last), of least
    row number among equal ids. Rows are told apart by number, so null and repeated ids are judged by text."""
    rows = numbered(docs, "_row")
    found = ngram_join(rows, text=text, doc_id="_row", **how).select(F.col("doc_id").alias("_row"), "component_id")
    found = staged(found, "components")
    shared = found.groupBy("component_id").agg(F.count("*").alias("c")).where("c > 1")
    members = found.join(shared, "component_id").join(rows.select("_row", F.col(doc_id).alias("id")), "_row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "_row")).alias("first"))
    gone = members.join(first, "component_id").where("_row <> first._row").select("_row")
    return rows.join(gone, "_row", "left_anti").drop("_row")
