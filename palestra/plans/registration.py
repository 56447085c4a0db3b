"""Intake of sign-up requests: user, member and subscription together, or a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palestra.asof import AsOf
from palestra.operators.changes import with_defaults
from palestra.operators.checks import failed_rules
from palestra.operators.joins import Hint, fits, rows_for
from palestra.operators.numbering import highest_key, numbered
from palestra.operators.ranking import first_per_group
from palestra.plans.club_rules import rules_of, stored_text
from palestra.session import durable
from palestra.sources.seeds import MEMBER_USER_TYPE
from palestra.sources.tables import ClubTables

EMAIL_TAKEN = "Este email já está registado."
NIF_TAKEN = "NIF already registered"
PLAN_UNKNOWN = "Plan not found"

_USER_FIELDS = ["email", "password", "name"]
_MEMBER_FIELDS = [
    "nif", "phone", "iban", "birthdate", "gender", "address", "city", "postalcode",
]
_DEFAULTED = {"userid", "usertypeid", "isactive", "memberid", "registrationdate"}


@dataclass(frozen=True)
class Registration:
    users: DataFrame
    member: DataFrame
    membersubscription: DataFrame
    rejects: DataFrame


def _typed(requests: DataFrame) -> DataFrame:
    """Form fields as the tables hold them; unreadable dates and numbers become NULL and
    fail the rule for required columns."""
    texts = [("users", c) for c in _USER_FIELDS]
    texts += [("member", c) for c in _MEMBER_FIELDS if c != "birthdate"]
    given = requests.select(
        "request_id", *[F.col(c).cast("string").alias(c) for c in
                        [*_USER_FIELDS, *_MEMBER_FIELDS, "plan"]]
    )
    return given.select(
        "request_id",
        *[stored_text(table, c).alias(c) for table, c in texts],
        F.col("birthdate").try_cast("date").alias("birthdate"),
        F.col("plan").try_cast("int").alias("plan"),
    )


def _own_rules(table: str):
    """Rules on the columns a request fills itself."""
    skip = {f"required:{c}" for c in _DEFAULTED}
    return [r for r in rules_of(table) if r.rule not in skip]


def _outcomes(undecided: DataFrame) -> DataFrame:
    """Outcomes that follow from requests which are first for their email and NIF.

    Among the two first of each email and each NIF, a request without an earlier rival
    wins, and one with a single earlier rival has the opposite of its outcome. These
    pointers are followed by doubling, so a chain settles in the logarithm of its length.
    """
    order = [F.col("arrival")]
    by_email = first_per_group(undecided, "email", order, 2)
    by_nif = first_per_group(undecided, "nif", order, 2)
    first_of = lambda df, c: df.groupBy(c).agg(F.min("arrival").alias(f"{c}_first"))
    both = by_email.join(by_nif.select("arrival"), "arrival")
    earlier = lambda c: F.when(F.col(f"{c}_first") < F.col("arrival"), F.col(f"{c}_first"))
    rivals = F.array_distinct(F.array_compact(F.array(earlier("email"), earlier("nif"))))
    steps = (
        both.join(first_of(by_email, "email"), "email").join(first_of(by_nif, "nif"), "nif")
        .withColumn("rivals", rivals).where("size(rivals) < 2")
        .select("arrival", F.get("rivals", 0).alias("rival"), F.lit(False).alias("opposite"))
        .withColumn("opposite", F.col("rival").isNotNull())
    )
    steps = durable(steps)
    while not steps.where("rival IS NOT NULL").isEmpty():
        ahead = steps.select(
            F.col("arrival").alias("rival"), F.col("rival").alias("next"),
            F.col("opposite").alias("turned"), F.lit(True).alias("known"),
        )
        # a rival that is undecided itself leaves those behind it undecided
        steps = durable(
            steps.join(ahead, "rival", "left").where("rival IS NULL OR known").select(
                "arrival", F.col("next").alias("rival"),
                (F.col("opposite") != F.coalesce("turned", F.lit(False))).alias("opposite"),
            )
        )
    return steps.select("arrival", (~F.col("opposite")).alias("wins"))


def _first_come(candidates: DataFrame) -> DataFrame:
    """The requests that win when they are taken one after the other and each blocks its
    email and its NIF for those that follow. Rounds go on until none is undecided; each
    settles whole chains, and all that share something with a winner."""
    undecided = durable(candidates.select("arrival", "email", "nif"))
    won = undecided.limit(0)
    while not undecided.isEmpty():
        outcomes = _outcomes(undecided)
        winners = undecided.join(outcomes.where("wins"), "arrival", "left_semi")
        won = durable(won.unionByName(winners))
        undecided = durable(
            undecided.join(outcomes.select("arrival"), "arrival", "left_anti")
            .join(won.select("email"), "email", "left_anti")
            .join(won.select("nif"), "nif", "left_anti")
        )
    return won.select("arrival", "email")


def register_members(t: ClubTables, as_of: AsOf, requests: DataFrame) -> Registration:
    """Take in sign-up requests in the order of ``request_id``.

    An accepted request gives an active user, a member and a subscription of one year. A
    rejected one gives the first reason it meets: email taken, a broken rule of the user,
    of the member, NIF taken, plan unknown.
    """
    typed = _typed(requests)
    # names and passwords stay out of the stored tables: requests are numbered and judged by
    # what can collide, and meet the rest of their fields by a hash of all of them at the end
    fields = [c for c in typed.columns if c != "request_id"]
    told = F.xxhash64(*fields, F.array(*[F.col(c).isNull() for c in fields]))
    broken = F.concat(failed_rules(_own_rules("users")), failed_rules(_own_rules("member")))
    arrivals = numbered(
        typed.select(
            "request_id", told.alias("fields"), "email", "nif", "plan",
            F.get(broken, 0).alias("broken"),
        ),
        ["request_id", "email", "fields"],
        "arrival",
    )
    # emails and NIFs are unique in store, so a small batch finds few of them
    hint = Hint(fits(arrivals))
    known_email = rows_for(t["users"].select("email"), arrivals, ["email"], hint).distinct()
    known_nif = rows_for(t["member"].select("nif"), arrivals, ["nif"], hint).distinct()
    known_plan = rows_for(
        t["plan"].select(F.col("planid").alias("plan")), arrivals, ["plan"], hint
    )
    judged = durable(
        arrivals.join(hint(known_email.withColumn("email_known", F.lit(True))), "email", "left")
        .join(hint(known_nif.withColumn("nif_known", F.lit(True))), "nif", "left")
        .join(hint(known_plan.withColumn("plan_known", F.lit(True))), "plan", "left")
        .withColumn(
            "reason",
            F.when(F.col("email_known"), F.lit(EMAIL_TAKEN))
            .when(F.col("broken").isNotNull(), F.col("broken"))
            .when(F.col("nif_known"), F.lit(NIF_TAKEN))
            .when(F.col("plan_known").isNull(), F.lit(PLAN_UNKNOWN)),
        )
    )
    accepted = _first_come(judged.where("reason IS NULL"))

    # an email that an earlier accepted request took outranks every other reason
    taken = accepted.select("email", F.col("arrival").alias("taken_by"))
    rejects = (
        judged.join(accepted.select("arrival"), "arrival", "left_anti")
        .join(taken, "email", "left")
        .select(
            "request_id",
            F.when(F.col("taken_by") < F.col("arrival"), F.lit(EMAIL_TAKEN))
            .otherwise(F.coalesce("reason", F.lit(NIF_TAKEN)))
            .alias("reason"),
        )
    )

    # as with a sequence, a rejected request leaves a gap in the keys
    arrival = F.col("arrival")
    keys = judged.join(accepted.select("arrival"), "arrival", "left_semi").select(
        "request_id", "fields",
        (arrival + highest_key(t["users"], "userid")).alias("userid"),
        (arrival + highest_key(t["member"], "memberid")).alias("memberid"),
        (arrival + highest_key(t["membersubscription"], "subscriptionid")).alias("subscriptionid"),
    )
    # of requests that are equal in all fields at most one is accepted
    given = typed.withColumn("fields", told).dropDuplicates(["request_id", "fields"])
    rows = given.join(
        hint(keys.withColumnsRenamed({"request_id": "_id", "fields": "_fields"})),
        F.col("request_id").eqNullSafe(F.col("_id")) & (F.col("fields") == F.col("_fields")),
    )
    users = rows.select(
        "userid", *_USER_FIELDS, F.lit(MEMBER_USER_TYPE).alias("usertypeid")
    )
    member = rows.select("memberid", "userid", *_MEMBER_FIELDS)
    subscription = rows.select(
        "subscriptionid", F.col("plan").alias("planid"), "memberid",
        as_of.today().alias("startdate"), F.add_months(as_of.today(), 12).alias("enddate"),
    )
    return Registration(
        users=with_defaults(users, "users", as_of),
        member=with_defaults(member, "member", as_of),
        membersubscription=with_defaults(subscription, "membersubscription", as_of),
        rejects=rejects,
    )
