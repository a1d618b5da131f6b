"""Order-management Parquet tables seen as a work tracker.

Orders become tickets, nations projects, parts epics and customers users. Every table is read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.enrich import with_ticket_defaults
from .schemas import TABLES

AS_OF = "2001-08-01"
EMAIL_DOMAIN = "example.com"
BASE_URL = "https://tracker.example.com/"


def _case(selector: str, *values) -> Column:
    """The value at the position the SQL selector gives; the last one for any other position."""
    *listed, last = [F.lit(v) if not isinstance(v, Column) else v for v in values]
    pairs = list(enumerate(listed))
    return reduce(lambda acc, p: acc.when(F.expr(selector) == p[0], p[1]), pairs[1:],
                  F.when(F.expr(selector) == pairs[0][0], pairs[0][1])).otherwise(last)


class Warehouse:
    """Lazy logical tables over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    # -- tickets ------------------------------------------------------------

    def raw_tickets(self) -> DataFrame:
        """Tickets as exported, with missing people and priorities still null."""
        lines = self.table("lineitem").groupBy("l_orderkey").agg(
            F.max("l_shipdate").alias("last_ship"), F.min("l_partkey").alias("first_part"))
        customers = self.table("customer").select(
            "c_custkey", "c_name", "c_mktsegment", "c_nationkey", self._account_id().alias("account_id"))
        nations = self.table("nation").select("n_nationkey", "n_name")
        joined = (self.table("orders")
                  .join(customers, F.col("o_custkey") == F.col("c_custkey"))
                  .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
                  .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
        unassigned = F.expr("o_orderkey % 13 = 0")
        status = (F.when(F.col("o_orderstatus") == "F", _case("o_orderkey % 4", "Done", "Closed", "Resolved", "Completed"))
                  .when(F.col("o_orderstatus") == "O", _case("o_orderkey % 4", "To Do", "Open", "New", "Backlog"))
                  .otherwise(_case("o_orderkey % 4", "In Progress", "Active", "Development", "Blocked")))
        urgency = F.col("o_orderpriority")
        priority = (F.when(urgency == "1-URGENT", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'Highest' ELSE 'Critical' END"))
                    .when(urgency == "2-HIGH", "High")
                    .when(urgency == "3-MEDIUM", "Medium")
                    .when(urgency == "4-NOT SPECIFIED", F.lit(None))
                    .otherwise(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'Lowest' ELSE 'Low' END")))
        return joined.select(
            F.expr("concat(n_name, '-', o_orderkey)").alias("key"),
            F.expr("concat('Order ', o_orderkey, ' for ', c_mktsegment)").alias("summary"),
            F.expr("CASE WHEN o_orderstatus <> 'P' THEN concat('Raised for ', c_mktsegment) END").alias("description"),
            status.alias("status"),
            F.when(~unassigned, F.col("c_name")).alias("assignee"),
            F.when(~unassigned, F.col("account_id")).alias("assignee_id"),
            F.col("n_name").alias("project"),
            _case("o_custkey % 4", "Task", "Bug", "Story", "Epic").alias("issue_type"),
            F.expr("o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR").alias("created"),
            F.expr("last_ship + (o_custkey % 24) * INTERVAL 1 HOUR").alias("updated"),
            priority.alias("priority"),
            F.expr("CASE WHEN o_orderkey % 17 <> 0 THEN concat('Reporter ', n_nationkey) END").alias("reporter"),
            F.expr("concat('NATION_', first_part % 25, '-E', first_part)").alias("epic_link"),
            F.expr("CASE WHEN o_orderkey % 9 = 0 AND n_nationkey <> 7 THEN 100 + n_nationkey END").alias("sprint_id"),
        )

    def tickets(self) -> DataFrame:
        return with_ticket_defaults(self.raw_tickets())

    # -- projects, epics ----------------------------------------------------

    def projects(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        leads = self.table("supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("lead"))
        return (nation.join(region, nation.n_regionkey == region.r_regionkey)
                .join(leads, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
            F.col("n_name").alias("key"), F.expr("concat(r_name, ' ', n_name)").alias("name"),
            F.col("n_nationkey").cast("string").alias("id"), F.lit("").alias("description"),
            F.coalesce("lead", F.lit("")).alias("lead")))

    def epics(self) -> DataFrame:
        project = "concat('NATION_', p_partkey % 25)"
        return self.table("part").select(
            F.expr(f"concat({project}, '-E', p_partkey)").alias("key"),
            F.expr("""CASE WHEN p_partkey % 70 = 0 THEN 'Bugs and Configuration'
                           WHEN p_partkey % 98 = 0 THEN concat('(NATION_', p_partkey % 25, ') Bugs and Configuration Overflow')
                           ELSE concat(p_brand, ' ', p_type, ' ', p_name) END""").alias("summary"),
            F.lit("").alias("description"),
            F.expr("CASE WHEN p_size % 2 = 0 THEN 'Open' ELSE 'Done' END").alias("status"),
            F.lit("Unassigned").alias("assignee"), F.lit("Unknown").alias("reporter"),
            F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00' + p_partkey * INTERVAL 1 HOUR").alias("created"),
            F.expr("TIMESTAMP_NTZ '2000-01-02 00:00:00' + p_partkey * INTERVAL 1 HOUR").alias("updated"),
            F.expr(project).alias("project"),
            "p_partkey", "p_type", "p_name",
        )

    def epic_queries(self) -> DataFrame:
        """One approximate epic title per supplier: a prefix, shared words or a misspelling."""
        typo = F.translate(F.lower("summary"), "aeor", "xxx")
        return self.table("supplier").select("s_suppkey").join(
            self.epics(), F.col("s_suppkey") == F.col("p_partkey")).select(
            F.col("s_suppkey").alias("query_id"), "project",
            (F.when(F.expr("s_suppkey % 6 = 0"), F.substring(F.lower("summary"), 1, 12))
             .when(F.expr("s_suppkey % 6 = 2"), F.expr("concat(p_name, ' qqq ', p_type)"))
             .otherwise(typo)).alias("title"))

    # -- users --------------------------------------------------------------

    @staticmethod
    def _account_id() -> Column:
        return F.concat(_case("c_custkey % 3", "5d8b8c8e-", "557058:", "712020:"), F.col("c_custkey"))

    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("pos"),
            self._account_id().alias("accountId"),
            F.expr("""CASE WHEN c_custkey % 50 = 0 THEN concat('Automation bot ', c_custkey)
                           ELSE concat(c_mktsegment, ' C', c_custkey) END""").alias("displayName"),
            F.expr("""CASE WHEN c_custkey % 11 = 0 THEN ''
                           ELSE concat(lower(c_mktsegment), '.c', c_custkey, '@example.com') END""").alias("emailAddress"),
            (F.col("c_acctbal") >= 0).alias("active"))

    def user_queries(self) -> DataFrame:
        """One name, address or unknown person per supplier."""
        return self.table("supplier").select("s_suppkey").join(
            self.table("customer"), F.col("s_suppkey") == F.col("c_custkey")).select(
            F.col("s_suppkey").alias("query_id"),
            _case("s_suppkey % 4",
                  F.expr("concat(lower(c_mktsegment), ' c', c_custkey)"), F.expr("lower(c_mktsegment)"),
                  F.expr("concat(lower(c_mktsegment), '.c', c_custkey, '@example.com')"),
                  F.expr("concat('nobody x', s_suppkey)")).alias("q"))

    # -- boards, sprints ----------------------------------------------------

    def boards(self) -> DataFrame:
        """One board per supplier; most are named after the supplier's nation."""
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.expr("""CASE WHEN s_suppkey % 5 = 0 THEN concat('Shared board ', s_suppkey)
                           ELSE concat('nation_', s_nationkey, ' board ', s_suppkey) END""").alias("name"),
            F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'scrum' ELSE 'kanban' END").alias("type"))

    def sprints(self) -> DataFrame:
        """One sprint per board; some carry their number in the link only."""
        return self.table("supplier").select(
            F.expr("CASE WHEN s_suppkey % 4 <> 1 THEN 100 + s_suppkey END").alias("id"),
            F.col("s_suppkey").alias("board_id"),
            F.expr("concat('Sprint ', s_suppkey)").alias("name"),
            F.expr("CASE WHEN s_suppkey % 3 = 2 THEN 'active' ELSE 'closed' END").alias("state"),
            F.expr("concat('https://tracker.example.com/sprint/', 100 + s_suppkey)").alias("self"))

    # -- requests -----------------------------------------------------------

    def ticket_requests(self) -> DataFrame:
        """One new-ticket request per customer."""
        parts = self.epics().select("p_partkey", F.col("project").alias("epic_project"), F.col("summary").alias("epic_title"))
        customers = self.table("customer").join(parts, F.col("c_custkey") == F.col("p_partkey"), "left")
        return customers.select(
            F.col("c_custkey").alias("request_id"),
            F.expr("concat('NATION_', c_custkey % 25)").alias("project"),
            F.expr("concat('Request ', c_custkey)").alias("summary"),
            F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END").alias("description"),
            F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'Bug' END").alias("issue_type"),
            F.expr("CASE WHEN c_custkey % 4 = 1 THEN 'High' END").alias("priority"),
            _case("c_custkey % 6", F.lit(None).cast("string"), F.expr("lower(c_mktsegment)"),
                  F.expr("concat(' ', lower(c_mktsegment), ' c', c_custkey)"), F.expr("concat('nobody x', c_custkey)"),
                  F.expr("concat('557058:', c_custkey)"),
                  F.expr("concat(lower(c_mktsegment), '.c', c_custkey, '@example.com')")).alias("assignee"),
            _case("c_custkey % 5", F.lit(None).cast("string"), F.expr("concat('EPIC-', c_custkey)"),
                  F.upper("epic_title"), F.expr("concat('see ', epic_title, ' please')"),
                  F.expr("''")).alias("epic_link"),
            F.expr("c_acctbal / 1000").alias("story_points"),
            F.expr("c_custkey % 2 = 0").alias("assign_active_sprint"),
            F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'In Progress' END").alias("status"))

    def epic_requests(self) -> DataFrame:
        return self.table("supplier").join(self.user_queries(), F.col("s_suppkey") == F.col("query_id"), "left").select(
            F.col("s_suppkey").alias("request_id"), F.expr("concat('NATION_', s_nationkey)").alias("project"),
            F.col("s_name").alias("summary"), F.expr("CASE WHEN s_acctbal < 0 THEN 'Negative' END").alias("description"),
            F.expr("CASE WHEN s_suppkey % 5 <> 0 THEN q END").alias("assignee"))

    def deployment_requests(self) -> DataFrame:
        """One deployment per supplier, for no, one, two or unknown development tickets."""
        tickets = self.order_keys()
        key = F.col("ticket_key")
        none = F.array().cast("array<string>")
        missing = F.expr("concat('MISSING-', s_suppkey)")
        return (self.table("supplier")
                .join(tickets, F.col("s_suppkey") == F.col("o_orderkey"), "left")
                .join(self.user_queries(), F.col("s_suppkey") == F.col("query_id"), "left")
                .select(F.col("s_suppkey").alias("request_id"),
                        F.expr("concat('NATION_', s_nationkey)").alias("project"),
                        _case("s_suppkey % 5", none, F.array(key), F.array(key, missing), F.array(missing), none).alias("dev_keys"),
                        F.expr("CASE WHEN s_suppkey % 5 = 4 OR s_suppkey % 7 = 0 THEN concat('Ship ', s_name) END").alias("title"),
                        F.expr("CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END").alias("description"),
                        F.expr("CASE WHEN s_suppkey % 3 <> 1 THEN q END").alias("assignee"),
                        F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'High' END").alias("priority"),
                        F.expr("CASE WHEN s_suppkey % 4 <> 0 THEN concat('pr/', s_suppkey) END").alias("pr_link"),
                        F.expr("CASE WHEN s_suppkey % 6 = 0 THEN s_name END").alias("qa_contacts"),
                        F.expr("CASE WHEN s_suppkey % 8 = 0 THEN 'Check the totals' END").alias("qa_instructions"),
                        F.expr("s_acctbal / 1000").alias("story_points")))

    def order_keys(self) -> DataFrame:
        """Ticket key of every order."""
        return (self.table("orders").select("o_orderkey", "o_custkey")
                .join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
                .join(self.table("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
                .select("o_orderkey", F.expr("concat(n_name, '-', o_orderkey)").alias("ticket_key")))

    def edits(self) -> DataFrame:
        """Two edits per order: the second may overwrite what the first set."""
        keys = self.order_keys()
        first = keys.select(
            "ticket_key", F.lit(1).alias("seq"),
            _case("o_orderkey % 3", F.lit(None).cast("string"), F.lit(""),
                  F.expr("concat('New summary ', o_orderkey)")).alias("summary"),
            F.lit(None).cast("string").alias("description"),
            F.expr("CASE WHEN o_orderkey % 20 = 0 THEN 'High' END").alias("priority"))
        second = keys.select(
            "ticket_key", F.lit(2).alias("seq"),
            F.expr("CASE WHEN o_orderkey % 6 = 2 THEN concat('Newer summary ', o_orderkey) ELSE '' END").alias("summary"),
            F.expr("CASE WHEN o_orderkey % 10 = 5 THEN 'Edited' END").alias("description"),
            F.lit(None).cast("string").alias("priority"))
        return first.unionByName(second)

    def assignments(self) -> DataFrame:
        return self.user_queries().join(self.order_keys(), F.col("query_id") == F.col("o_orderkey")).select(
            "ticket_key", F.col("query_id").alias("seq"), F.col("q").alias("assignee"))

    def transitions(self) -> DataFrame:
        """Three workflow moves per ticket; the third is named after the ticket's project."""
        named = self.order_keys().withColumn("_name", F.expr("concat('Hand to ', substring_index(ticket_key, '-', 1))"))
        return named.select(
            "ticket_key", F.posexplode(F.array(F.lit("In Progress"), F.lit("Done"), F.col("_name"))).alias("pos", "name")
        ).select("ticket_key", F.expr("cast(10 * pos + 11 as string)").alias("id"), "name", "pos")

    def status_requests(self) -> DataFrame:
        return self.order_keys().select(
            "ticket_key", _case("o_orderkey % 3", "DONE", "in progress", "Nope").alias("new_status"))

    def status_histories(self) -> DataFrame:
        """One status request per order line, by line, then part."""
        names = ["Start", "finish", "Reopen", "block", "Unblock", "Vanish"]
        return self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(
            self.order_keys(), F.col("l_orderkey") == F.col("o_orderkey")).select(
            "ticket_key", F.expr("l_linenumber * 1000000L + l_partkey").alias("seq"), _case("l_partkey % 6", *names).alias("new_status"))

    def workflows(self) -> DataFrame:
        """Five transitions per project; projects with an odd number cannot reopen, and every third one starts from To Do alone."""
        moves = F.expr("""explode(array(
            named_struct('pos', 0, 'name', 'Start', 'froms', IF(n_nationkey % 3 = 0, array('To Do'), array('To Do', 'Open', 'New', 'Backlog')), 'to_status', 'In Progress'),
            named_struct('pos', 1, 'name', 'Finish', 'froms', array('In Progress', 'Active', 'Development'), 'to_status', 'Done'),
            named_struct('pos', 2, 'name', 'Reopen', 'froms', IF(n_nationkey % 2 = 1, array(), array('Done', 'Closed', 'Resolved', 'Completed')), 'to_status', 'Open'),
            named_struct('pos', 3, 'name', 'Block', 'froms', array('Open', 'In Progress', 'Active'), 'to_status', 'Blocked'),
            named_struct('pos', 4, 'name', 'Unblock', 'froms', array('Blocked'), 'to_status', 'In Progress')))""").alias("m")
        return self.table("nation").select("n_name", moves).select(
            F.col("n_name").alias("workflow"), F.explode("m.froms").alias("from_status"), "m.pos",
            F.expr("concat(n_name, ':', m.pos)").alias("id"), "m.name", "m.to_status")

    # -- chat ---------------------------------------------------------------

    def chat_history(self) -> DataFrame:
        return self.table("conversations")

    def activities_json(self) -> DataFrame:
        """Every chat turn as the JSON text of one activity."""
        account = F.struct(F.col("role").alias("id"), F.upper("role").alias("name"))
        return self.chat_history().select(F.to_json(F.struct(
            F.expr("CASE WHEN role = 'user' THEN 'message' ELSE 'typing' END").alias("type"),
            "text", F.expr("concat(conv_id, ':', turn)").alias("id"),
            F.lit("https://chat.example.com").alias("serviceUrl"),
            F.struct(F.col("conv_id").cast("string").alias("id")).alias("conversation"),
            account.alias("from"),
            F.struct(F.lit("bot").alias("id"), F.lit("Bot").alias("name")).alias("recipient"))).alias("value"))

    # -- the same tables as exported JSON -------------------------------------

    @staticmethod
    def _issue() -> Column:
        """A row as an issue; a missing column value leaves its field out."""
        def named(c, field="name"):
            return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias(field)))

        def iso(c):
            return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0000"))

        return F.struct("key", F.struct(
            "summary", "description", named("status").alias("status"), named("priority").alias("priority"),
            named("assignee", "displayName").alias("assignee"), named("reporter", "displayName").alias("reporter"),
            named("project", "key").alias("project"), named("issue_type").alias("issuetype"),
            iso("created").alias("created"), iso("updated").alias("updated"),
            F.col("epic_link").alias("customfield_10014"), F.col("story_points").alias("customfield_10016")).alias("fields"))

    @classmethod
    def _pages(cls, issues: DataFrame) -> DataFrame:
        """Rows as one-issue pages."""
        return issues.select(F.to_json(F.struct(F.array(cls._issue()).alias("issues"), F.lit(True).alias("isLast"))).alias("value"))

    def user_pages_json(self) -> DataFrame:
        """Users on pages of fifty by offset; the last page may be short. Addresses left out where empty."""
        u = self.users().withColumn("page", F.expr("(pos - 1) DIV 50"))
        user = F.struct("pos", F.struct("accountId", "displayName", F.expr("nullif(emailAddress, '')").alias("emailAddress"), "active").alias("user"))
        pages = u.groupBy("page").agg(F.sort_array(F.collect_list(user)).alias("u"))
        return pages.select(F.to_json(F.struct(
            (F.col("page") * 50).alias("startAt"), F.lit(50).alias("maxResults"), F.col("u.user").alias("values"))).alias("value"))

    def issue_chain(self) -> DataFrame:
        """Tickets on pages by ranges of order keys, one export per project: ``export, page, token, next, issues``; the first token is null."""
        t = self.raw_tickets().withColumns({"story_points": F.lit(None).cast("double"),
                                            "number": F.element_at(F.split("key", "-"), -1).cast("long")})
        t = t.withColumn("page", F.expr("number DIV 1500"))
        pages = t.groupBy(F.col("project").alias("export"), "page").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("number", self._issue().alias("issue")))), lambda x: x["issue"]).alias("issues"))
        order = Window.partitionBy("export").orderBy("page")
        token = F.substring(F.md5(F.concat_ws("/", "export", "page").cast("binary")), 1, 10)
        return pages.select("export", "page", F.when(F.lag("page").over(order).isNotNull(), token).alias("token"),
                            F.lead(token).over(order).alias("next"), "issues",
                            F.row_number().over(order).alias("place"), F.count("*").over(Window.partitionBy("export")).alias("n_pages"))

    @staticmethod
    def _chain_json(pages: DataFrame) -> DataFrame:
        return pages.select(F.to_json(F.struct("export", F.col("token").alias("pageToken"), "issues", F.col("next").isNull().alias("isLast"),
                                               F.col("next").alias("nextPageToken"))).alias("value"))

    def chained_issue_pages_json(self) -> DataFrame:
        return self._chain_json(self.issue_chain())

    def broken_issue_pages_json(self) -> DataFrame:
        """The same, but of every five projects one lacks its second page, one answers that token twice, one leads from its last page back to the
        second, and one lacks its first page."""
        order = Window.partitionBy("export").orderBy("page")
        c = self.issue_chain().withColumn("second", F.first("next").over(order))
        kind = F.expr("CAST(substring_index(export, '_', -1) AS INT) % 5")
        c = c.withColumn("kind", kind).where("NOT (kind = 0 AND place = 2) AND NOT (kind = 3 AND place = 1)")
        back = F.when((F.col("kind") == 2) & (F.col("place") == F.col("n_pages")), F.col("second")).otherwise(F.col("next"))
        c = c.withColumn("next", back)
        again = c.where("kind = 1 AND place = 2").withColumn("issues", F.slice("issues", 1, 1))
        return self._chain_json(c.unionByName(again))

    def issue_pages_json(self) -> DataFrame:
        return self._pages(self.raw_tickets().withColumn("story_points", F.lit(None).cast("double")))

    def epic_pages_json(self) -> DataFrame:
        none = F.lit(None).cast("string")
        return self._pages(self.epics().withColumns({
            "description": none, "assignee": none, "reporter": none, "priority": none, "epic_link": none,
            "issue_type": F.lit("Epic"), "story_points": F.lit(None).cast("double")}))

    def users_json(self) -> DataFrame:
        """User records; empty addresses and true flags are left out."""
        u = self.users()
        return u.select(F.to_json(F.struct("accountId", "displayName",
                                           F.expr("nullif(emailAddress, '')").alias("emailAddress"),
                                           F.expr("nullif(active, true)").alias("active"))).alias("value"))

    def projects_json(self) -> DataFrame:
        lead = F.when(F.col("lead") != "", F.struct(F.col("lead").alias("displayName")))
        return self.projects().select(F.to_json(F.struct("key", "name", "id", lead.alias("lead"))).alias("value"))

    def boards_json(self) -> DataFrame:
        return self.boards().select(F.to_json(F.struct("*")).alias("value"))

    def sprints_json(self) -> DataFrame:
        return self.sprints().select(F.to_json(F.struct("*")).alias("value"))

    # -- tracker fields --------------------------------------------------------

    def fields(self) -> DataFrame:
        """Field definitions, one per part."""
        return self.table("part").select(
            F.col("p_partkey").alias("pos"), F.expr("concat('customfield_', p_partkey)").alias("id"),
            F.expr("CASE WHEN p_size = 13 THEN ' Story Points ' ELSE p_name END").alias("name"))
