"""Who a document belongs to: record keys, eligibility, links between copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions.hashing import keyed_hash
from sieveline.functions.patterns import matches
from sieveline.functions.text import js_trim
from sieveline.operators.skew import join_per_key, positions
from sieveline.session import materialise

PAGE_ROWS = 200


def first_email(emails: Column) -> Column:
    return F.get(F.filter(emails, lambda e: F.contains(e, F.lit("@"))), F.lit(0))


def record_key(secret: str, emails: Column, phones: Column, file_hash: Column) -> Column:
    """Keyed hash of the e-mail, else of the last ten phone digits, else the hash of the file."""
    digits = F.filter(F.transform(phones, lambda p: F.regexp_replace(p, "[^0-9]", "")), lambda d: F.length(d) >= 8)
    phone = F.right(F.get(digits, F.lit(0)), F.lit(10))
    email = F.lower(js_trim(first_email(emails)))
    return (
        F.when(email.isNotNull(), F.concat(F.lit("e:"), keyed_hash(secret, email)))
        .when(phone.isNotNull(), F.concat(F.lit("p:"), keyed_hash(secret, phone)))
        .otherwise(F.concat(F.lit("f:"), file_hash))
    )


def eligibility(statement: Column, locations: Column) -> Column:
    said = F.coalesce(statement, F.lit(""))
    return (
        F.when(matches(said, fixed.ELIGIBLE_NO_PATTERN), "stated_no")
        .when(matches(said, fixed.ELIGIBLE_YES_PATTERN), "stated_yes")
        .when(F.exists(locations, lambda place: matches(place, fixed.ELIGIBLE_PLACE_PATTERN)), "stated_yes")
        .otherwise("unstated")
    )


def split_identity(extracts: DataFrame, secret: str) -> DataFrame:
    """The restricted candidate row of each document: the only place identity is kept."""
    who = F.col("identity")
    email = first_email(who["emails"])
    return extracts.select(
        "doc_id",
        record_key(secret, who["emails"], who["phones"], F.col("file_hash")).alias("record_key"),
        who["name"].alias("display_name"),
        email.alias("email"),
        F.get(who["phones"], F.lit(0)).alias("phone"),
        who["urls"].alias("urls"),
        email.isNull().alias("no_contact"),
        eligibility(F.col("relocation_statement"), who["locations"]).alias("eligibility"),
    )


def link_groups(candidates: DataFrame, id_col: str = "candidate_id", keys: tuple[str, ...] = ("pool_id", "record_key")) -> DataFrame:
    """Every candidate with the group it is linked in: the group's first id and the number of others.

    All records of a key are linked to each other. The group is kept as (head, size) instead of an
    array of the others on every row, which would be quadratic in the largest group.
    """
    groups = candidates.groupBy(*keys).agg(
        F.min(id_col).alias("link_head"), F.count(F.lit(1)).alias("group_size")
    )
    return join_per_key(candidates, groups, list(keys), size_col="group_size").withColumn(
        "n_linked", F.col("group_size") - 1
    ).drop("group_size")


def linked_with(links: DataFrame, asked: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """(asked id, linked id) for the candidates in ``asked``: the group opened only where it is read."""
    mine = links.filter(F.col("n_linked") > 0).join(asked.select(id_col).distinct(), id_col, "left_semi")
    wanted = mine.select(F.col(id_col), "pool_id", "link_head")
    others = links.select(F.col(id_col).alias("linked_id"), "pool_id", "link_head")
    return wanted.join(others, ["pool_id", "link_head"]).filter(F.col(id_col) != F.col("linked_id")).select(id_col, "linked_id")


def cut_pages(rows: DataFrame, groups: list[str], order: list[str], members: Column, page_rows: int) -> DataFrame:
    """The rows of every group in order, cut into pages: (groups, page from 0, n_pages, members), one row per page.

    A page holds at most ``page_rows`` rows and a group is ranked in slices, so no task meets a whole group. Rows that
    are equal in ``order`` and ``members`` are kept as often as they come. ``groups`` and ``order`` are never null.
    """
    placed = positions(rows, groups, [F.col(c) for c in order])
    member = F.struct(F.col("position"), members.alias("member"))
    pages = materialise(
        placed.groupBy(*groups, F.floor((F.col("position") - 1) / page_rows).alias("page"))
        .agg(F.transform(F.array_sort(F.collect_list(member)), lambda m: m["member"]).alias("members"))
    )
    sizes = pages.groupBy(*groups).agg((F.max("page") + 1).alias("n_pages"))
    return join_per_key(pages, sizes, groups, size_col="n_pages").select(*groups, "page", "n_pages", "members")


def link_pages(links: DataFrame, page_rows: int = PAGE_ROWS, id_col: str = "candidate_id") -> DataFrame:
    """The members of every group of two or more in order of id, by page: see ``cut_pages``.

    Repeated rows of an id are members of their own, as ``n_linked`` counts them. Rows without an id or a pool are on
    no page. ``links`` is read several times: hand in a written table.
    """
    members = links.filter((F.col("n_linked") > 0) & F.col("pool_id").isNotNull() & F.col(id_col).isNotNull())
    return cut_pages(members.select(id_col, "pool_id", "link_head"), ["pool_id", "link_head"], [id_col], F.col(id_col), page_rows)


def _opened(links: DataFrame, pages: DataFrame, asked: DataFrame, id_col: str) -> DataFrame:
    """(asked id, page, n_pages, member), one row per member of the page asked for.

    Who asks is counted per page before pages are joined, and the pages most asked for go to where the rows are, so a
    page that a third of all rows ask for is no hot key.
    """
    keys = ["pool_id", "link_head", "page"]
    questions = asked.select(id_col, F.col("page").cast("bigint").alias("page")).distinct()
    mine = links.filter(F.col("n_linked") > 0).select(id_col, "pool_id", "link_head").distinct()
    wanted = materialise(mine.join(questions, id_col))
    opened = materialise(wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_asked")).join(pages, keys))
    found = join_per_key(wanted, opened, keys, size_col="n_asked")
    return found.select(id_col, "page", "n_pages", F.explode("members").alias("member"))


def linked_on_page(links: DataFrame, pages: DataFrame, asked: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """(asked id, page, n_pages, linked id) for the (id, page) rows of ``asked``: one page each, never the group.

    The rows out are at most ``page_rows`` per row asked. Pages below 0 or behind the last, unknown ids and ids linked
    with nothing give no row; a question asked twice counts once.
    """
    found = _opened(links, pages, asked, id_col).withColumnRenamed("member", "linked_id")
    return found.filter(F.col(id_col) != F.col("linked_id"))


def open_pages(links: DataFrame, evaluations: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The open applications of every group of two or more, by page, in order of candidate, role and status.

    A candidate's applications are rows of their own. Withdrawn and declined ones are left out before pages are cut;
    a missing status is open.
    """
    still = evaluations.filter(~F.coalesce("pipeline_status", F.lit("")).isin("declined", "withdrawn"))
    linked = links.filter((F.col("n_linked") > 0) & F.col("pool_id").isNotNull()).select("candidate_id", "pool_id", "link_head")
    # Nulls have no place in an order of keys: each column goes in as a pair that tells them apart.
    rows = materialise(
        linked.join(still.select("candidate_id", "role_applied", "pipeline_status"), "candidate_id").withColumn(
            "sort_by",
            F.struct("candidate_id", *[x for c in ("role_applied", "pipeline_status") for x in (F.col(c).isNotNull().alias(f"has_{c}"), F.coalesce(c, F.lit("")).alias(c))]),
        )
    )
    member = F.struct(F.col("candidate_id").alias("linked_id"), "role_applied", "pipeline_status")
    return cut_pages(rows, ["pool_id", "link_head"], ["sort_by"], member, page_rows)


def open_applications_on_page(links: DataFrame, pages: DataFrame, asked: DataFrame) -> DataFrame:
    """(candidate, page, n_pages, linked id, role, status): one page of the person's other open applications.

    ``pages`` come from ``open_pages``; a candidate's own applications stand on them and are left out here.
    """
    found = _opened(links, pages, asked, "candidate_id").select("candidate_id", "page", "n_pages", "member.*")
    return found.filter(F.col("candidate_id") != F.col("linked_id"))


def open_applications(links: DataFrame, asked: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Linked applications of the same person that are still open."""
    pairs = linked_with(links, asked)
    theirs = evaluations.select(F.col("candidate_id").alias("linked_id"), "role_applied", "pipeline_status")
    return pairs.join(theirs, "linked_id").filter(
        ~F.coalesce("pipeline_status", F.lit("")).isin("declined", "withdrawn")
    )
