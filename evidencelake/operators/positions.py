"""Appointments and positions in the wording of chronologies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.operators import research

#: Role words, longest rank first, marks of organisations, and verbs of appointment.
ROLES = ("第一书记", "代理书记", "副秘书长", "秘书长", "副总司令", "总司令", "副司令员", "司令员", "副政治委员", "政治委员", "副委员长", "委员长", "第一副主席", "第二副主席", "第三副主席", "副主席", "主席", "第一副总理", "第二副总理", "副总理", "总理", "副部长", "部长", "副主任", "主任", "副书记", "书记", "总参谋长", "副参谋长", "参谋长", "委员", "政委")
ORGANIZATIONS = ("中共中央", "中央", "国务院", "政务院", "委员会", "军委", "军区", "野战军", "兵团", "政府", "书记处", "政治局", "外交部", "国防部", "组织部")
VERBS = r"(?:被任命为|被委任为|被选为|当选为|担任|兼任|任(?!命))"
CLAUSE_END = r"[，,。；;]|并(?:出席|参加|主持|会见|访问|前往|赴)"


#: Words before a name that make an appointment a mere wish, verbs before a name, and what joins several posts.
WISHES, NAMING, AND = "要求|建议|提议|主张", "任命|委任|选举|决定由", r"(?:并)?兼(?:任)?|、"
REACH = 100


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _posts(tail: Column) -> Column:
    """The posts of a text that follows a verb, to the end of its clause."""
    return F.split(F.regexp_replace(tail, rf"(?s)(?:{CLAUSE_END}).*$", ""), AND, -1)


def appointments(text: Column, name: Column) -> Column:
    """Posts that a text gives a person, white space aside.

    After each mention that a verb of appointment follows at once, unless it is wished
    for; else after the first naming of the person to a post; else, where the text
    itself begins with a verb of appointment, what follows that.
    """
    word = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))

    def of_body(body: Column) -> Column:
        after = F.regexp_extract_all(body, F.concat(F.lit(rf"(?<!(?:{WISHES})由?)"), word, F.lit(rf"(?=({VERBS}.{{0,{REACH}}}))")), F.lit(1))
        own = F.flatten(F.transform(after, lambda t: _posts(F.regexp_replace(F.substring(t, 1, REACH), f"^{VERBS}", ""))))
        named = F.get(F.regexp_extract_all(body, F.concat(F.lit(f"(?:{NAMING})"), word, F.lit(rf"(?:为|担任|兼任)(.{{0,{REACH}}})")), F.lit(1)), F.lit(0))
        opening = F.when(body.rlike(f"^{VERBS}"), _posts(F.regexp_replace(body, f"^{VERBS}", "")))
        otherwise = _let(named, lambda n: F.when(n.isNotNull(), _posts(n)).otherwise(F.coalesce(opening, F.array().cast("array<string>"))))
        return _let(own, lambda o: F.when(F.size(o) > 0, o).otherwise(otherwise))

    return F.filter(_let(F.regexp_replace(text, r"(?U)\s+", ""), of_body), lambda p: p != "")


def position(phrase: Column) -> Column:
    """Struct of organization and role of a phrase; null unless it ends in a role after a name that has the mark of an organisation.

    White space, and marks at either end, do not count; a phrase of two posts (和) names none.
    """
    plain = F.regexp_replace(F.regexp_replace(phrase, r"(?U)\s+", ""), "^[：:、，和及的]+|[：:、，和及的]+$", "")
    # each step is worked out once: written out in each other, they would be worked out again for every role and mark
    return _let(plain, lambda p: _let(F.get(F.filter(F.array(*map(F.lit, ROLES)), lambda r: F.endswith(p, r)), F.lit(0)), lambda role: _of_role(p, role)))


def _of_role(plain: Column, role: Column) -> Column:
    def of_body(body: Column) -> Column:
        # a minister's ministry keeps its last character
        organization = F.when((role == "部长") & ~F.endswith(body, F.lit("部")), F.concat(body, F.lit("部"))).otherwise(body)
        return _let(organization, lambda o: F.when(_good(o) & role.isNotNull() & (F.length(body) >= 2) & ~F.contains(plain, F.lit("和")), F.struct(o.alias("organization"), role.alias("role"))))

    def _good(organization: Column) -> Column:
        return F.exists(F.array(*map(F.lit, ORGANIZATIONS)), lambda m: F.contains(organization, m)) & (organization != "中央")

    return _let(F.regexp_replace(F.substring(plain, F.lit(1), F.length(plain) - F.length(role)), "^的+|的+$", ""), of_body)


def relationships(mentions: DataFrame) -> DataFrame:
    """Positions held, from events and the people and evidence of each.

    mentions has event_id, event_type, review_status, description, start_value,
    person_id, mention and evidence_id.  Rejected events and those that name no
    appointment are left out.  One row a person, organisation, role and start, with all
    its evidence and events, sorted.
    """
    wanted = mentions.where("review_status <> 'rejected'").where((F.col("event_type") == "appointment") | F.contains("description", F.lit("任")))
    posts = wanted.withColumn("post", F.explode(F.transform(appointments(F.col("description"), F.col("mention")), position))).where("post IS NOT NULL")
    key = ["person_id", F.col("post.organization").alias("organization"), F.col("post.role").alias("role"), "start_value"]
    sorted_set = lambda c: F.array_sort(F.collect_set(c)).alias(c + "s")
    return posts.groupBy(*key).agg(sorted_set("evidence_id"), sorted_set("event_id"))


#: Relations and statuses that tenure may be asked for.
RELATIONS = ("held_position", "member_of", "led", "direct_subordinate")
STATUSES = ("confirmed", "unreviewed", "needs_review")


def tenure(relations: DataFrame, evidence: DataFrame, at: str | None = None, types: tuple[str, ...] = RELATIONS, statuses: tuple[str, ...] = STATUSES, limit: int = 50, offset: int = 0) -> DataFrame:
    """Page of each person's positions, of those held ``at`` a partial date if it is given, with sorted evidence.

    relations has relation_id, person_id, relation_type, review_status, organization,
    start_value and end_value; evidence has relation_id and evidence_id.  Relations
    without evidence or organisation are left out, and so are confirmed ones without a
    start.  Adds place, total and has_more.
    """
    if not types or not statuses or set(types) - set(RELATIONS) or set(statuses) - set(STATUSES):
        raise ValueError("unknown or no relation types or statuses")
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("a page has 1 to 200 rows from an offset of 0 or more")
    rows = relations.where(F.col("relation_type").isin(*types) & F.col("review_status").isin(*statuses) & F.col("organization").isNotNull())
    rows = rows.where((F.col("review_status") != "confirmed") | F.col("start_value").isNotNull())
    if at is not None:
        rows = research.held_at(rows, "start_value", "end_value", at)
    proofs = evidence.groupBy("relation_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    return research.page_of(rows.join(proofs, "relation_id"), "person_id", [F.asc_nulls_first("start_value"), "relation_id"], offset, limit)


#: Questions on careers, roles asked for (those of the party apart), and words of change.
CAREER_QUESTION = "党内职务|职务变化|职务变动|任职|担任|出任"
CAREER_ROLES = "第一书记|副书记|书记|候补委员|常务委员|常委|委员|副主席|主席|秘书长|副部长|部长|负责人|政治委员|政委|党代表|中央局|党委|党支部|特委|前委"
PARTY_ROLES = "第一书记|副书记|书记|候补委员|常务委员|常委|(?<!政治)委员|副主席|主席|秘书长|副部长|部长|负责人|党代表|中央局|党委|党支部|特委|前委"
CHANGES = "担任|出任|当选|选举|任命|改任|调任|兼任|升任|增补|组成|进入|成为|任职|免去|免职|撤销|辞去|代理"
TAKES = "担任|出任|当选为|选为|任命为|改任|调任|兼任|升任|增补为|成为|任职为|代理|为|任"
LEADING = r"^(?:(?:请问|请|梳理|介绍|概括|总结))?([\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}·]{2,8}?)(?=在|\s|(?:18|19|20)\d{2})"


def career_hits(hits: DataFrame) -> DataFrame:
    """``hits`` (question, people, title, text) without those that, asked about a career, tie no person to a role.

    A clause ties them if the person takes a role in it, stands next to one, or helps to
    form a body of it; in a source whose title names the person, if it holds a role and a
    change.  Without people the one that opens the question counts; without that, or for
    other questions, every hit stays.
    """
    leading = F.regexp_extract(F.trim("question"), LEADING, 1)
    given = F.coalesce("people", F.array().cast("array<string>"))
    people = F.when(F.size(given) > 0, given).when(leading != "", F.array(leading)).otherwise(given)
    rows = hits.withColumn("__people", people).withColumn("__role", F.when(F.contains("question", F.lit("党内")), PARTY_ROLES).otherwise(CAREER_ROLES))
    role = F.concat(F.lit("(?:"), "__role", F.lit(")"))

    def tied(clause: Column, person: Column) -> Column:
        name = F.concat(F.lit(r"\Q"), person, F.lit(r"\E"))
        takes = F.concat(name, F.lit(f".{{0,10}}(?:{TAKES}).{{0,12}}"), role)
        forms = F.concat(name, F.lit(".{0,60}组成.{0,20}"), role)
        return F.rlike(clause, F.concat(takes, F.lit("|"), role, F.lit(".{0,6}"), name, F.lit("|"), forms))

    clauses = F.split("text", r"(?<=[，,。！？；;])|\n+", -1)
    titled = F.exists("__people", lambda p: F.contains("title", p))
    tells = F.exists(clauses, lambda c: F.exists("__people", lambda p: tied(c, p)) | (titled & F.rlike(c, role) & c.rlike(CHANGES)))
    free = ~F.col("question").rlike(CAREER_QUESTION) | (F.size("__people") == 0)
    return rows.where(free | F.coalesce(tells, F.lit(False))).drop("__people", "__role")
