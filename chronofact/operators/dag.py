"""The commit DAG: reachability by chains, merge bases, patch ids, validity as of a head, classification of head moves, revalidation.

Commits are laid out in chains along first parents: a commit hands its chain on to the child that most commits descend from, so a path back along
first parents changes chains a logarithm of times at most. What a head reaches is, of each chain, everything up to some place, and reachability of a
pair is a comparison of places. A row a chain stands for all its commits; no closure of commits is made, and a search takes as many rounds as a path
changes chains, not as the history is deep.

For many heads no head's reach is written out: a commit reaches what its first parent reaches, itself, and what a merge adds. Only what merges add is
kept (`steps`), so a branch that was merged once is a row once, not a row for every later head.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.storage import join_by_key, materialise, stored

#: Heads' histories up to so many rows are held by every task; longer ones are joined by shuffle.
MANY_COMMITS = 2_000_000
#: Sums along a chain are made by blocks of so many commits.
BLOCK = 512
#: Merges between two places of a chain are met by blocks of so many commits.
NEAR = 256


def _sizes(commits: DataFrame, first: DataFrame) -> DataFrame:
    """(c, n): how many commits descend from each along first parents, itself included; in round i those nearer than 2^(i + 1)."""
    jump, size = materialise(first.select("c", "p")), commits.select("c", F.lit(1).cast("bigint").alias("n"))
    while jump.take(1):
        more = jump.join(size, "c").groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("m"))
        size = materialise(size.join(more, "c", "left").select("c", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")))
        jump = materialise(jump.join(jump.select(F.col("c").alias("p"), F.col("p").alias("q")), "p").select("c", F.col("q").alias("p")))
    return size


class Chains:
    """places: commit_id, chain, pos, least (the smallest id from the chain's start up to here). links: chain, pos, to_chain, to_pos, the parents that aren't the commit before.

    parents: commit_id, parent_id, a row a parent (null for none) and, if commits have several, `place`, 0 for the first. Ids are whole numbers.
    """

    def __init__(self, parents: DataFrame) -> None:
        place = F.col("place") if "place" in parents.columns else F.lit(0)
        rows = materialise(parents.select(F.col("commit_id").cast("bigint").alias("c"), F.col("parent_id").cast("bigint").alias("p"), place.alias("place")))
        row = F.xxhash64("c", "p", "place")
        n, total, mixed = rows.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
        # The index of the same commits is made once.
        self.name = f"chains-{n}-{total}-{mixed}"
        self.spark, self.rows = parents.sparkSession, rows
        self.places = stored(self.spark, f"{self.name}/places", lambda: self._places(rows))
        self.links = stored(self.spark, f"{self.name}/links", lambda: self._links(rows))

    @staticmethod
    def _known(rows: DataFrame) -> DataFrame:
        """Rows with a parent that is there; those of a shallow history may be missing."""
        return rows.filter("p IS NOT NULL").join(rows.select(F.col("c").alias("p")).distinct(), "p", "left_semi")

    @classmethod
    def _first(cls, rows: DataFrame) -> DataFrame:
        """(c, p): each commit's first parent."""
        return cls._known(rows).groupBy("c").agg(F.min_by("p", F.struct("place", "p")).alias("p"))

    def _places(self, rows: DataFrame) -> DataFrame:
        commits = rows.select("c").distinct()
        first = self._first(rows)
        heir = first.join(_sizes(commits, first), "c").groupBy("p").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("c"))
        # By doubling: each commit knows the commit 2^i before it on its chain, or the chain's start.
        at = materialise(commits.join(heir, "c", "left").select("c", F.coalesce("p", "c").alias("chain"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("bigint").alias("pos"), F.least("c", "p").alias("least")))
        while True:
            far = at.select(F.col("c").alias("chain"), F.col("chain").alias("__chain"), F.col("pos").alias("__pos"), F.col("least").alias("__least"))
            next_ = materialise(at.join(far, "chain").select("c", F.col("__chain").alias("chain"), (F.col("pos") + F.col("__pos")).alias("pos"), F.least("least", "__least").alias("least"), (F.col("__pos") > 0).alias("moved")))
            at = next_.drop("moved")
            if not next_.filter("moved").take(1):
                break
        return at.withColumnRenamed("c", "commit_id")

    def _links(self, rows: DataFrame) -> DataFrame:
        at = self.places.withColumnRenamed("commit_id", "c")
        own, other = at.select("c", "chain", "pos"), at.select(F.col("c").alias("p"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
        links = self._known(rows).select("c", "p").distinct().join(own, "c").join(other, "p").filter("chain <> to_chain OR pos <> to_pos + 1")
        return links.groupBy("chain", "pos", "to_chain").agg(F.max("to_pos").alias("to_pos"))

    def reach(self, heads: DataFrame) -> DataFrame:
        """(head, chain, pos): up to where a head (column head) reaches each chain, itself included. Unknown heads reach nothing."""
        known = materialise(heads.select(F.col("head").cast("bigint").alias("head")).distinct().join(self.places.withColumnRenamed("commit_id", "head"), "head").select("head", "chain", "pos"))
        front = known.withColumn("after", F.lit(-1).cast("bigint"))
        while True:
            met = front.join(self.links.withColumnRenamed("pos", "at"), "chain").filter("at <= pos AND at > after")
            met = met.groupBy("head", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("pos"))
            old = known.withColumnRenamed("pos", "after")
            front = materialise(met.join(old, ["head", "chain"], "left").withColumn("after", F.coalesce("after", F.lit(-1).cast("bigint"))).filter("pos > after"))
            if not front.take(1):
                return known
            known = materialise(known.unionByName(front.drop("after")).groupBy("head", "chain").agg(F.max("pos").alias("pos")))

    @cached_property
    def paths(self) -> DataFrame:
        """(chain, via, upto): the other chains that the way back along first parents from a chain's start goes through, and from where. A logarithm of the commits for a chain at most."""

        def make() -> DataFrame:
            starts, ends = self.places.filter("pos = 0").select(F.col("commit_id").alias("c"), "chain"), self.places.select(F.col("commit_id").alias("p"), F.col("chain").alias("via"), F.col("pos").alias("upto"))
            forks = materialise(starts.join(self._first(self.rows), "c").join(ends, "p").select("chain", "via", "upto", F.lit(0).alias("turn")))
            back = forks.select(F.col("chain").alias("via"), F.col("via").alias("__via"), F.col("upto").alias("__upto"))
            found = front = forks
            while front.take(1):
                front = materialise(front.join(back, "via").select("chain", F.col("__via").alias("via"), F.col("__upto").alias("upto"), (F.col("turn") + 1).alias("turn")))
                found = found.unionByName(front)
            return found

        return stored(self.spark, f"{self.name}/paths", make)

    @cached_property
    def routes(self) -> DataFrame:
        """(chain, path, n): a chain's row of `paths` as an array, the nearest first, and its number of commits."""

        def make() -> DataFrame:
            path = self.paths.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("turn", "via", "upto"))).alias("path"))
            return self.places.groupBy("chain").agg(F.count(F.lit(1)).alias("n")).join(path, "chain").select("chain", F.transform("path", lambda x: F.struct(x["via"].alias("via"), x["upto"].alias("upto"))).alias("path"), "n")

        return stored(self.spark, f"{self.name}/routes", make)

    def _floored(self, new: DataFrame, known: DataFrame) -> DataFrame:
        """new with `floor`: up to where the first parent of the commit at (chain, at) reaches to_chain, as far as `known` and `new` tell; -1 for nowhere."""
        both = known.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
        before = W.partitionBy("chain", "to_chain").orderBy("at", "__new").rowsBetween(W.unboundedPreceding, -1)
        own = both.withColumn("__own", F.max("far").over(before)).filter("__new").drop("__new")
        way = new.select("chain", "at", "to_chain").join(self.paths.drop("turn"), "chain")
        passed = way.filter("via = to_chain").select("chain", "at", "to_chain", F.col("upto").alias("__high"))
        added = way.join(both.select(F.col("chain").alias("via"), F.col("at").alias("__at"), "to_chain", F.col("far").alias("__high")), ["via", "to_chain"]).filter("__at <= upto")
        high = passed.unionByName(added.select(*passed.columns)).groupBy("chain", "at", "to_chain").agg(F.max("__high").alias("__high"))
        least = F.lit(-1).cast("bigint")
        floor = F.greatest(F.coalesce("__own", least), F.coalesce("__high", least), F.when(F.col("chain") == F.col("to_chain"), F.col("at") - 1).otherwise(least))
        return own.join(high, ["chain", "at", "to_chain"], "left").select("chain", "at", "to_chain", "far", floor.alias("floor"))

    @cached_property
    def steps(self) -> DataFrame:
        """(chain, at, to_chain, far, floor): the merge at (chain, at) reaches to_chain up to `far`, its first parent only up to `floor`."""

        def make() -> DataFrame:
            forks = self.paths.filter("turn = 0").select("chain", F.lit(0).cast("bigint").alias("pos"), F.col("via").alias("to_chain"), F.col("upto").alias("to_pos"))
            front = self.links.join(forks, ["chain", "pos", "to_chain", "to_pos"], "left_anti").select("chain", F.col("pos").alias("at"), "to_chain", F.col("to_pos").alias("far"))
            known, front = front.limit(0), materialise(front)
            links = self.links.select(F.col("chain").alias("to_chain"), "pos", F.col("to_chain").alias("__chain"), "to_pos")
            while front.take(1):
                new = materialise(self._floored(front, known).filter("far > floor"))
                known = materialise(known.unionByName(new.drop("floor")).groupBy("chain", "at", "to_chain").agg(F.max("far").alias("far")))
                met = new.join(links, "to_chain").filter("pos <= far AND pos > floor")
                front = materialise(met.groupBy("chain", "at", F.col("__chain").alias("to_chain")).agg(F.max("to_pos").alias("far")))
            return self._floored(known, known.limit(0)).filter("far > floor")

        return stored(self.spark, f"{self.name}/steps", make)

    def ancestors(self) -> DataFrame:
        """(commit_id, n, root): how many commits each commit reaches, itself included, and the smallest id of them. Merges' additions are summed along chains, then along paths."""
        ends = self.places.select(F.col("chain").alias("to_chain"), F.col("pos").alias("far"), "least")
        adds = self.steps.join(ends, ["to_chain", "far"]).groupBy("chain", F.col("at").alias("pos")).agg(F.sum(F.col("far") - F.col("floor")).alias("__more"), F.min("least").alias("__low"))
        rows = materialise(self.places.join(adds, ["chain", "pos"], "left").withColumn("__block", F.floor(F.col("pos") / BLOCK)))
        upto = W.partitionBy("chain", "__block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
        before = W.partitionBy("chain").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
        blocks = rows.groupBy("chain", "__block").agg(F.sum("__more").alias("__m"), F.min("__low").alias("__l"))
        blocks = blocks.select("chain", "__block", F.sum("__m").over(before).alias("__m"), F.min("__l").over(before).alias("__l"))
        zero = F.lit(0).cast("bigint")
        along = rows.withColumn("__more", F.sum("__more").over(upto)).withColumn("__low", F.min("__low").over(upto)).join(blocks, ["chain", "__block"])
        along = materialise(along.select("commit_id", "chain", "pos", (F.col("pos") + 1 + F.coalesce("__more", zero) + F.coalesce("__m", zero)).alias("n"), F.least("least", "__low", "__l").alias("root")))
        ways = self.paths.join(along.select(F.col("chain").alias("via"), F.col("pos").alias("upto"), "n", "root"), ["via", "upto"])
        ways = ways.groupBy("chain").agg(F.sum("n").alias("__n"), F.min("root").alias("__root"))
        ways = materialise(ways.join(self.routes.select("chain", F.col("n").alias("__w")), "chain"))
        out = join_by_key(along, ways, ["chain"], "__w", self._total, F.col("commit_id"))
        return out.select("commit_id", (F.col("n") + F.coalesce("__n", zero)).alias("n"), F.least("root", "__root").alias("root"))

    @cached_property
    def _total(self) -> int:
        return self.places.count()

    def _ways(self, rows: DataFrame, spread: str) -> DataFrame:
        """rows (chain, pos) with `ways`: an array of (via, upto), the own chain and those of its path."""
        own = F.array(F.struct(F.col("chain").alias("via"), F.col("pos").alias("upto")))
        return join_by_key(rows, self.routes, ["chain"], "n", self._total, F.col(spread)).withColumn("ways", F.concat(own, F.coalesce("path", F.slice(own, 1, 0)))).drop("path", "n")

    def reaches(self, pairs: DataFrame, head: str, commit: str, flag: str) -> DataFrame:
        """pairs with a boolean column: whether `head` reaches `commit`."""
        asked = pairs.select(F.col(head).cast("bigint").alias("__h"), F.col(commit).cast("bigint").alias("__c")).distinct()
        asked = asked.join(self.places.select(F.col("commit_id").alias("__h"), "chain", "pos"), "__h").join(self.places.select(F.col("commit_id").alias("__c"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos")), "__c")
        passed = F.exists("ways", lambda x: (x["via"] == F.col("to_chain")) & (F.col("to_pos") <= x["upto"]))
        asked = materialise(self._ways(asked, "__c").withColumn("passed", passed))
        # A chain that starts after a place has no merge that adds to what is behind it on the place's own chain.
        open_ = asked.filter("NOT passed AND chain <> to_chain").select("__h", "__c", "to_chain", "to_pos", F.inline("ways")).filter("via <> to_chain")
        added = open_.join(self.steps.withColumnRenamed("chain", "via"), ["via", "to_chain"]).filter("at <= upto AND far >= to_pos").select("__h", "__c")
        found = asked.filter("passed").select("__h", "__c").unionByName(added.distinct()).withColumn(flag, F.lit(True))
        out = pairs.join(found, (F.col(head).cast("bigint") == F.col("__h")) & (F.col(commit).cast("bigint") == F.col("__c")), "left")
        return out.select(*pairs.columns, F.coalesce(flag, F.lit(False)).alias(flag))

    def reached(self, heads: DataFrame) -> DataFrame:
        """(head, commit_id): every commit that each head reaches."""
        far = self.reach(heads).withColumnRenamed("pos", "far")
        return self.places.join(far, "chain").filter("pos <= far").select("head", "commit_id")

    def merge_bases(self, pairs: DataFrame) -> DataFrame:
        """(l, r, base): the best common ancestors of each pair, those that no other common ancestor descends from; there may be several, or none.

        Of a chain only the last common commit can be one, and it is unless a common commit of another chain has it as a parent.
        """
        pairs = pairs.select(F.col("l").cast("bigint").alias("l"), F.col("r").cast("bigint").alias("r")).distinct()
        known = self.places.select("commit_id")
        pairs = pairs.join(known.withColumnRenamed("commit_id", "l"), "l", "left_semi").join(known.withColumnRenamed("commit_id", "r"), "r", "left_semi")
        pairs = materialise(self.reaches(self.reaches(pairs, "l", "r", "__back"), "r", "l", "__on"))
        straight = pairs.filter("__back OR __on").select("l", "r", F.when(F.col("__on"), F.col("l")).otherwise(F.col("r")).alias("base"))
        # Of the others: the last commit that both ways back along first parents share, and what both reach beyond it.
        sides = pairs.filter("NOT __back AND NOT __on").select("l", "r")
        for x in ("l", "r"):
            at = sides.join(self.places.select(F.col("commit_id").alias(x), "chain", "pos"), x)
            sides = self._ways(at, "l").withColumnRenamed("ways", f"__{x}").drop("chain", "pos")
        shared = F.filter("__l", lambda x: F.exists("__r", lambda y: y["via"] == x["via"]))[0]
        sides = sides.withColumn("__at", F.when(F.arrays_overlap(F.col("__l.via"), F.col("__r.via")), shared["via"]))
        place = lambda x: F.filter(f"__{x}", lambda y: y["via"] == F.col("__at"))[0]["upto"]
        sides = materialise(sides.withColumn("__pos", F.when(F.col("__at").isNotNull(), F.least(place("l"), place("r")))))

        def beyond(x: str) -> DataFrame:
            """(l, r, chain, pos): what one side reaches that the shared commit doesn't."""
            near = F.slice(f"__{x}", F.lit(1), F.when(F.col("__at").isNull(), F.size(f"__{x}")).otherwise(F.array_position(F.col(f"__{x}.via"), F.col("__at")).cast("int")))
            way = sides.select("l", "r", "__at", "__pos", F.inline(near)).withColumn("__lo", F.when(F.col("via") == F.col("__at"), F.col("__pos")).otherwise(-1))
            own = way.filter("upto > __lo").select("l", "r", F.col("via").alias("chain"), F.col("upto").alias("pos"))
            blocks = way.filter("upto > __lo").withColumn("__block", F.explode(F.sequence(F.floor((F.col("__lo") + 1) / NEAR), F.floor(F.col("upto") / NEAR))))
            steps = self.steps.withColumnRenamed("chain", "via").withColumn("__block", F.floor(F.col("at") / NEAR))
            more = blocks.join(steps, ["via", "__block"]).filter("at <= upto AND at > __lo").select("l", "r", F.col("to_chain").alias("chain"), F.col("far").alias("pos"))
            return own.unionByName(more).groupBy("l", "r", "chain").agg(F.max("pos").alias("pos"))

        both = beyond("l").withColumnRenamed("pos", "__p").join(beyond("r"), ["l", "r", "chain"]).select("l", "r", "chain", F.least("pos", "__p").alias("pos"))
        last = sides.filter("__at IS NOT NULL").select("l", "r", F.col("__at").alias("chain"), F.col("__pos").alias("pos"))
        common = materialise(both.unionByName(last).groupBy("l", "r", "chain").agg(F.max("pos").alias("pos")))
        links = self.links.select(F.col("chain").alias("from_chain"), F.col("pos").alias("from_pos"), F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"))
        children = common.join(links, ["chain", "pos"]).join(common.select("l", "r", F.col("chain").alias("from_chain"), F.col("pos").alias("__to")), ["l", "r", "from_chain"])
        best = common.join(children.filter("from_pos <= __to").select("l", "r", "chain", "pos").distinct(), ["l", "r", "chain", "pos"], "left_anti")
        return best.join(self.places, ["chain", "pos"]).select("l", "r", F.col("commit_id").alias("base")).unionByName(straight)


def reachable(parents: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, commit_id): what each head reaches, itself included."""
    return Chains(parents).reached(heads)


def patch_id(diff: Column) -> Column:
    """A hash of a change alone: without the lines that name blobs, the places of hunks and white space; null for an empty one. So a rebased or picked commit has its origin's."""
    lines = F.filter(F.split(diff, "\n", -1), lambda x: ~x.startswith("index "))
    bare = F.array_join(F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, "^@@ [^@]*@@", "@@"), r"\s+", "")), "\n")
    return F.when(F.trim(F.replace(bare, F.lit("\n"), F.lit(""))) != "", F.sha2(bare, 256))


def reachable_patches(commits: DataFrame, reach: DataFrame) -> DataFrame:
    """(patch_id): of what a head reaches, merges left out. commits: commit_id, patch_id, merge; reach: commit_id."""
    return commits.filter("NOT merge AND patch_id IS NOT NULL").join(reach.select("commit_id"), "commit_id", "left_semi").select("patch_id").distinct()


def _flag(df: DataFrame, reach: DataFrame, commit: str, flag: str, small: bool) -> DataFrame:
    known = reach.select(F.col("commit_id").alias(f"__{flag}"), F.lit(True).alias(flag))
    return df.join(F.broadcast(known) if small else known, F.col(commit).cast("bigint") == F.col(f"__{flag}"), "left").drop(f"__{flag}").withColumn(flag, F.coalesce(flag, F.lit(False)))


def flagged(anchors: DataFrame, reach: DataFrame) -> DataFrame:
    """anchors with at_from, at_until, at_intro: whether the head of `reach` reaches those commits."""
    small = reach.count() <= MANY_COMMITS
    for commit, flag in (("valid_from", "at_from"), ("valid_until", "at_until"), ("introduced_by", "at_intro")):
        anchors = _flag(anchors, reach, commit, flag, small)
    return anchors


def valid_as_of(branch: str, repo: str | None = None) -> Column:
    """Over flagged anchors left-joined to facts: without an anchor always; else by repo, commits and branch."""
    anchored = F.coalesce("repo_id", "branch", F.col("valid_from").cast("string"), F.col("valid_until").cast("string"), F.col("introduced_by").cast("string")).isNotNull()
    right_repo = F.lit(True) if repo is None else F.coalesce(F.col("repo_id") == repo, F.lit(True))
    begun = F.col("valid_from").isNull() | F.col("at_from")
    open_ = F.col("valid_until").isNull() | ~F.col("at_until")
    here = F.coalesce(F.col("branch") == branch, F.lit(True)) | (F.col("introduced_by").isNotNull() & F.col("at_intro"))
    return ~anchored | (right_repo & begun & open_ & here)


def classify_move(from_: Column, to: Column, forward: Column, backward: Column, parents_of_to: Column, reverts: Column, same_branch: Column, related: Column | None = None) -> Column:
    """How a head moved. forward: `from` is an ancestor of `to`; backward the reverse. related: they have a common ancestor."""
    return (
        F.when(from_ == to, "noop").when(forward & (parents_of_to > 1), "merge").when(forward & reverts, "revert").when(forward, "fast_forward")
        .when(backward, "switch").when(~same_branch, "switch").when(reverts if related is None else reverts & related, "revert").otherwise("rebase")
    )


def is_revert(message: Column) -> Column:
    return message.rlike(r"(?i)^\s*revert\b") | message.rlike(r"(?i)\bThis reverts commit\b")


def revalidated(closed: DataFrame, reverted: DataFrame, branch: str) -> DataFrame:
    """Closed facts (flagged anchors) that live again: their branch stands at the head, and the closing commit is out of reach or undone.

    reverted: commit_id of commits that a reachable revert names.
    """
    stands = F.col("branch").isNull() | (F.col("branch") == branch) | F.when(F.col("introduced_by").isNotNull(), F.col("at_intro")).otherwise(F.col("at_from"))
    undone = reverted.select(F.col("commit_id").cast("bigint").alias("__u"), F.lit(True).alias("__undone"))
    out = closed.filter(F.col("valid_until").isNotNull() & stands).join(undone, F.col("valid_until").cast("bigint") == F.col("__u"), "left")
    return out.filter(~F.col("at_until") | F.coalesce("__undone", F.lit(False))).drop("__u", "__undone")


def anchored_at(head: Column, branch: Column) -> list[Column]:
    """An anchor's missing fields filled from the head."""
    return [F.coalesce("branch", branch).alias("branch"), F.coalesce(F.col("valid_from").cast("bigint"), head.cast("bigint")).alias("valid_from")]
