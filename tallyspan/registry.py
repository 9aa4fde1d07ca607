"""Registered queries over the driver's tables and the same results in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import money, narration, text
from .operators import anomalies, answers, audits, geometry, matching, report, semantic
from .plans import payload, projection
from .plans.reconcile import anomaly_rows, reconcile
from .shared import interim, keep_rows


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return projection.bank(spark, sf_dir), projection.ledger(spark, sf_dir)


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, ledger = _sides(spark, sf_dir)
    return bank.unionByName(ledger)


def _pairs_of_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank and ledger rows of one payment, whatever their stage would say."""
    bank, ledger = _sides(spark, sf_dir)
    side = lambda rows, p: matching.sided(matching.prepared(rows), p).withColumn("k", F.floor(F.col(f"{p}_ord") / 4))
    return side(bank, "bank").join(side(ledger, "ledger"), "k")


def bank_transactions(spark, sf_dir):
    return projection.bank(spark, sf_dir).drop("alt_references")


def ledger_transactions(spark, sf_dir):
    return projection.ledger(spark, sf_dir).drop("alt_references")


def fee_gap(spark, sf_dir):
    rows = _pairs_of_k(spark, sf_dir)
    return rows.select("bank_id", "ledger_id", money.fee_gap_plausible(F.col("bank_amount"), F.col("ledger_amount")).alias("plausible"), money.same_direction(F.col("bank_amount"), F.col("ledger_amount")).alias("same_direction"))


def distinctive_tokens(spark, sf_dir):
    return _all(spark, sf_dir).select("id", F.array_join(F.array_sort(text.distinctive_tokens(F.col("description"))), " ").alias("tokens"))


def token_dice(spark, sf_dir):
    rows = _pairs_of_k(spark, sf_dir)
    return rows.select("bank_id", "ledger_id", F.round(text.token_dice(F.col("bank_tokens"), F.col("ledger_tokens")), 6).alias("dice"))


def reference_match(spark, sf_dir):
    rows = _pairs_of_k(spark, sf_dir)
    return rows.select("bank_id", "ledger_id", text.references_match(F.col("bank_forms"), F.col("ledger_forms")).alias("matches"))


def citation_label(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.when(k % 4 == 0, "sheet_row").when(k % 4 == 1, "model_extracted").otherwise("pdf_line")
    label = report.citation(kind, F.when(k % 3 == 0, (k % 7 + 1).cast("int")), F.when(k % 5 != 0, (k % 90 + 1).cast("int")), (k % 90 + 1 + k % 2).cast("int"))
    return rows.select(k.cast("long").alias("k"), label.alias("label"))


def narration_parse(spark, sf_dir):
    """Narrations of all seven banks' shapes, made from orders, and what is read in them."""
    rows = projection.payments(spark, sf_dir).withColumn("n", F.concat(F.lit("N"), F.lpad(F.col("k").cast("string"), 9, "0")))
    party = F.upper("p")
    made = {
        "hdfc": F.concat(F.lit("UPI/P2M/"), "n", F.lit("/"), party, F.lit("/pay")),
        "sbi": F.concat(F.lit("BY TRANSFER-NEFT*HDFC0001*"), "n", F.lit("*"), party),
        "icici": F.concat(F.lit("MMT/IMPS/"), "n", F.lit("/ref-1/"), party),
        "pnb": F.concat(F.lit("RTGS/"), "n", F.lit("/"), party),
        "bob": F.concat(F.lit("UPI/"), "n", F.lit("/"), party, F.lit("/a@b")),
        "axis": F.concat(F.lit("CHQ DEP-"), "n"),
        "kotak": F.concat(F.lit("NEFT/"), "n", F.lit("/"), party, F.lit("/KKBK0000123")),
    }
    out = None
    for i, (bank, made_text) in enumerate(made.items()):
        said = F.when(F.col("k") % 11 == i, F.lit("SMS ALERT CHRG")).otherwise(made_text)
        parsed = rows.select("k", F.lit(bank).alias("bank"), narration.parse_narration(said, bank).alias("x")).select("k", "bank", "x.*")
        out = parsed if out is None else out.unionByName(parsed)
    return out


def match_exact_candidates(spark, sf_dir):
    rows = matching.exact_candidates(*_sides(spark, sf_dir))
    return rows.select("bank_id", "ledger_id", F.round("similarity", 6).alias("similarity"), "corroboration")


def match_exact(spark, sf_dir):
    return matching.match_exact(*_sides(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


def corroboration_mix(spark, sf_dir):
    return matching.match_exact(*_sides(spark, sf_dir)).groupBy("rule", "corroboration").agg(F.count("*").alias("n"))


def _after_exact(spark, sf_dir):
    with interim() as result:
        bank, ledger = map(matching.settle, _sides(spark, sf_dir))
        with interim() as exact_result:
            pairs = exact_result(matching.match_exact(bank, ledger), "exact")
        return result(matching.leftovers(bank, pairs, "bank_id"), "left"), result(matching.leftovers(ledger, pairs, "ledger_id"), "left")


def unmatched_bank(spark, sf_dir):
    return _after_exact(spark, sf_dir)[0].select("id", "amount")


def unmatched_ledger(spark, sf_dir):
    return _after_exact(spark, sf_dir)[1].select("id", "amount")


def near_candidates(spark, sf_dir):
    rows = matching.near_candidates(*_after_exact(spark, sf_dir))
    return rows.select("bank_id", "ledger_id", F.round("similarity", 6).alias("similarity"))


def match_near(spark, sf_dir):
    return matching.match_near(*_after_exact(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


def summary(spark, sf_dir):
    return reconcile(*_sides(spark, sf_dir)).summary()


def unexplained(spark, sf_dir):
    return reconcile(*_sides(spark, sf_dir)).totals().select(F.col("unexplained").cast("decimal(28,2)"))


def recon_identity(spark, sf_dir):
    one = reconcile(*_sides(spark, sf_dir)).totals()
    return one.select("difference", "pair_differences", "bank_only", "ledger_only", (F.col("difference") == F.col("explained")).alias("holds"))


def completeness(spark, sf_dir):
    """How many rows of each side are placed exactly once, and how many are not."""
    r = reconcile(*_sides(spark, sf_dir))
    wrong = audits.completeness(r.bank, r.pairs, r.bank_left, "bank_id").withColumn("source", F.lit("bank")).unionByName(audits.completeness(r.ledger, r.pairs, r.ledger_left, "ledger_id").withColumn("source", F.lit("ledger")))
    placed = r.bank.unionByName(r.ledger).join(wrong.select("id"), "id", "left_anti").groupBy("source").agg(F.count("*").alias("placed_once"))
    return placed.join(wrong.groupBy("source").agg(F.count("*").alias("wrong")), "source", "left").select("source", "placed_once", F.coalesce("wrong", F.lit(0)).cast("long").alias("wrong"))


def stage1_exact(spark, sf_dir):
    bank, ledger = _sides(spark, sf_dir)
    rows = report.paired(matching.match_exact(bank, ledger), bank, ledger)
    return rows.agg(F.count("*").alias("pairs"), F.count_if(F.col("amount_gap") != 0).alias("amounts_differ"), F.max("date_gap").alias("most_days"))


def dup_payments(spark, sf_dir):
    rows = anomalies.duplicate_clusters(_all(spark, sf_dir))
    return rows.select("source", "amount", F.array_join("members", ",").alias("members"), anomalies.duplicate_reason(1).alias("reason"))


def dup_rows(spark, sf_dir):
    """The members of duplicate clusters, a row each."""
    return anomalies.duplicate_rows(_all(spark, sf_dir)).select("source", "amount", "id", "date", "n")


def summary_sheet(spark, sf_dir):
    return reconcile(*_sides(spark, sf_dir)).summary_sheet()


def threshold_avoidance(spark, sf_dir):
    return anomalies.threshold_avoidance(_all(spark, sf_dir)).select("id", "source", F.col("threshold").cast("long").alias("threshold"), "reason")


def _rounded(spark, sf_dir):
    rows = projection.payments(spark, sf_dir)
    amount = F.when(F.col("k") % 10 == 0, F.round(F.col("a") / 1000, 0) * 1000).otherwise(F.col("a")).cast("decimal(18,2)")
    return rows.select(F.concat(F.lit("B"), "k").alias("id"), amount.alias("amount"))


def round_numbers(spark, sf_dir):
    return anomalies.round_numbers(_rounded(spark, sf_dir)).select("id", "amount", "reason")


def mirrored_entries(spark, sf_dir):
    return anomalies.mirrored_entries(_all(spark, sf_dir)).select("source", "positive_id", "negative_id", "size")


def timing_gaps(spark, sf_dir):
    rows = projection.payments(spark, sf_dir).select(F.concat(F.lit("B"), "k").alias("id"), F.col("k").alias("ord"), F.col("d").alias("date"), "customer")
    return anomalies.timing_gaps(rows, 14, ("customer",))


def dup_collapsed(spark, sf_dir):
    bank, ledger = _sides(spark, sf_dir)
    found = anomalies.collapse_duplicates(anomalies.duplicate_clusters(bank.unionByName(ledger)), matching.match(bank, ledger))
    return found.select("source", "kind", F.array_join(F.array_sort("members"), ",").alias("members"))


def anomaly_report(spark, sf_dir):
    """Rows of all flags of the whole run, by rule and source."""
    r = reconcile(*_sides(spark, sf_dir))
    return anomaly_rows(r.flags(), r.bank.unionByName(r.ledger)).groupBy("rule", "source").agg(F.count("*").alias("rows"), F.count_distinct("flag_id").alias("flags"))


def anomaly_rows_all(spark, sf_dir):
    """Each transaction of each flag of the whole run."""
    r = reconcile(*_sides(spark, sf_dir))
    return anomaly_rows(r.flags(), r.bank.unionByName(r.ledger)).select("rule", "source", "id", "date", "amount")


anomaly_rows_all.__name__ = "anomaly_rows"


def run_payload(spark, sf_dir):
    """The JSON entries of the whole run, but for its flags, read back."""
    rows = payload.entries(reconcile(*_sides(spark, sf_dir)), [s for s in payload.SECTIONS if s != "anomalies"])
    field = lambda *paths: F.coalesce(*[F.get_json_object("body", f"$.{p}") for p in paths])
    bank = F.when(F.col("section") == "unmatched_bank", field("id")).otherwise(field("bank.id"))
    ledger = F.when(F.col("section") == "unmatched_ledger", field("id")).otherwise(field("ledger.id"))
    return rows.select("section", bank.alias("bank_id"), ledger.alias("ledger_id"), field("rule").alias("rule"), field("issue", "reason").alias("note"), field("difference").cast("decimal(28,2)").alias("difference"))


def headline(spark, sf_dir):
    return payload.headline(payload.sections(reconcile(*_sides(spark, sf_dir))))


def model_rows(spark, sf_dir):
    """Answers that hold rows as JSON, bare, wrapped or fenced, made from orders and read."""
    rows = projection.payments(spark, sf_dir).groupBy("customer").agg(F.sort_array(F.collect_list(F.struct("d", "k", "a", "p"))).alias("x"))
    made = F.transform("x", lambda r: F.struct(r["d"].cast("string").alias("date"), F.concat(F.lit("pay [1] to "), r["p"]).alias("description"), F.concat(F.lit("N"), r["k"]).alias("reference"), F.when(r["a"] < 0, (-r["a"]).cast("string")).alias("debit"), F.when(r["a"] >= 0, r["a"].cast("string")).alias("credit")))
    body = F.to_json(made)
    said = F.when(F.col("customer") % 3 == 0, body).when(F.col("customer") % 3 == 1, F.concat(F.lit('{"rows": '), body, F.lit("}"))).otherwise(F.concat(F.lit("Here they are:\n```json\n"), body, F.lit("\n```\n")))
    read = rows.select("customer", F.explode(answers.rows_of(said)).alias("r")).select("customer", "r.*")
    amount = F.coalesce(money.parse_amount(F.col("credit")), F.lit(0)) - F.coalesce(money.parse_amount(F.col("debit")), F.lit(0))
    return read.select("customer", money.parse_date(F.col("date")).alias("date"), "description", "reference", amount.cast("decimal(18,2)").alias("amount"))


def model_answers(spark, sf_dir):
    """Questions about pairs, and answers with prose around them, made from orders and read."""
    rows = _pairs_of_k(spark, sf_dir)
    k = F.col("k")
    said = F.concat(F.when(k % 2 == 0, "Sure.\n```json\n").otherwise(""), F.to_json(F.struct(F.concat(F.lit("rows {of} "), k).alias("reasoning"), (k % 3 == 0).alias("is_match"), (k % 11 / 10).alias("confidence"))), F.when(k % 2 == 0, "\n```").otherwise(""))
    read = rows.select("bank_id", "ledger_id", answers.question().alias("q"), answers.confirmation_of(said).alias("x"))
    return read.select("bank_id", "ledger_id", F.regexp_extract("q", r"differ by ([0-9.]+) \(", 1).cast("decimal(18,2)").alias("gap"), F.regexp_extract("q", r"and ([0-9]+) day", 1).cast("long").alias("days"), "x.is_match", "x.confidence", "x.reasoning")


def match_hot_amounts(spark, sf_dir):
    """Line items as payments of fifty amounts: every amount has a large share of the rows."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # line numbers repeat within an order, so a line is named by its place there
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    items = items.withColumn("place", place)
    k = (F.col("l_orderkey") * 64 + F.col("place")).cast("long")
    party = F.substring(F.md5((F.col("l_suppkey") % 40).cast("string")), 1, 6)
    side = lambda source, p, date, said, ref: items.select(F.concat(F.lit(p), k).alias("id"), k.alias("ord"), F.lit(source).alias("source"), date.alias("date"), F.col("l_quantity").cast("decimal(18,2)").alias("amount"), said.alias("description"), ref.alias("reference"), F.array().cast("array<string>").alias("alt_references"))
    day = F.to_date("l_shipdate")
    bank = side("bank", "B", day, F.concat(F.lit("NEFT "), party), F.when(k % 3 == 0, F.concat(F.lit("R"), k)))
    ledger = side("ledger", "L", F.date_add(day, (k % 3).cast("int")), F.concat(F.lit("Payment to "), party), F.when(k % 5 != 0, F.concat(F.lit("R"), k)))
    return matching.match_exact(bank, ledger).withColumn("similarity", F.round("similarity", 6))


def match_issues(spark, sf_dir):
    return reconcile(*_sides(spark, sf_dir)).paired.select("bank_id", "ledger_id", "issue")


def _review(name):
    def query(spark, sf_dir):
        return report.review(reconcile(*_sides(spark, sf_dir)).paired)[name].select("bank_id", "ledger_id", F.col("amount_gap").cast("decimal(18,2)").alias("amount_gap"), "date_gap")

    query.__name__ = f"review_{name}"
    return query


def classify_unmatched(spark, sf_dir):
    return reconcile(*_sides(spark, sf_dir)).reasons().select("id", "source", "reason")


def _statement(spark, sf_dir):
    """A running balance per customer by date; every 97th order's amount is misprinted, every
    89th is not printed, every 83rd stands under the wrong sign."""
    rows = projection.payments(spark, sf_dir)
    w = Window.partitionBy("customer").orderBy("d", "k")
    balance = F.sum("a").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("decimal(18,2)")
    k = F.col("k")
    printed = F.when(k % 97 == 0, F.col("a") + 7).when(k % 89 == 0, F.lit(0)).when(k % 83 == 0, -F.col("a")).otherwise(F.col("a")).cast("decimal(18,2)")
    rows = rows.withColumns({"balance": balance, "amount": printed, "ord": F.row_number().over(w)})
    return rows.select(
        F.col("customer").cast("string").alias("file_name"), "k", "ord", "amount", "balance", F.greatest(-F.col("amount"), F.lit(0)).cast("decimal(18,2)").alias("debit"),
        F.greatest(F.col("amount"), F.lit(0)).cast("decimal(18,2)").alias("credit"), F.lit(0).cast("decimal(18,2)").alias("opening_balance"), "a",
    )


def balance_audit(spark, sf_dir):
    return audits.audit_balances(_statement(spark, sf_dir)).select("k", "status", "audited_amount", "printed_amount")


def footing_check(spark, sf_dir):
    rows = _statement(spark, sf_dir)
    totals = rows.groupBy("file_name").agg(F.sum("a").cast("decimal(18,2)").alias("closing"), F.lit(0).cast("decimal(18,2)").alias("opening"), F.lit(None).cast("decimal(18,2)").alias("withdrawals"), F.lit(None).cast("decimal(18,2)").alias("deposits"))
    return audits.footing(rows, totals).select("file_name", "extracted", "expected", "foots")


def client_activity(spark, sf_dir):
    from .operators.history import client_activity as activity

    clients = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("client_id"), F.col("c_name").alias("name"), F.lit("1990-01-01").cast("timestamp").alias("created_at"))
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").cast("long").alias("client_id"), F.col("o_orderdate").alias("created_at"))
    return activity(clients, runs).select("client_id", "name", "runs", F.to_date("last_run").alias("last_run"))


def run_history(spark, sf_dir):
    """Every client's runs, newest first."""
    from .operators.history import run_list

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    runs = orders.select(F.col("o_custkey").cast("long").alias("client_id"), F.col("o_orderkey").cast("long").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.lit("").alias("headline"))
    return run_list(runs).select("client_id", "run_id", F.to_date("created_at").alias("created"), "place")


def retention_purge(spark, sf_dir):
    from .operators.history import purged

    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    documents = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("run_id"), F.col("l_linenumber").cast("long").alias("document"))
    return purged(documents, runs, F.lit("1995-01-01").cast("timestamp")).groupBy("run_id").agg(F.count("*").alias("documents"))


def cosine_topk(spark, sf_dir):
    """For every vector whose id is divisible by 100, the three nearest of all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").cast("long").alias("ord"), F.col("embedding").alias("vector"))
    found = semantic.shortlist(rows.where("ord % 100 = 0"), rows, least=-1.0, same=False)
    return found.select(F.col("bank_id").cast("long").alias("query"), F.col("ledger_id").cast("long").alias("found"), F.round("score", 4).alias("score"), F.col("place").cast("long").alias("place"))


def _confirm(batch):
    """A stand-in scorer: how near the amounts are."""
    gap = (batch.bank_amount.astype(float) - batch.ledger_amount.astype(float)).abs()
    return (1 / (1 + gap / 100)).round(6).tolist()


def semantic_match(spark, sf_dir):
    """All leftovers of the exact stage, the vector of a row being that of the table's which its ord
    names."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    n = vectors.count()
    bank, ledger = (side.withColumn("v", F.col("ord") % n).join(vectors, "v").drop("v") for side in _after_exact(spark, sf_dir))
    found = semantic.match_semantic(bank, ledger, _confirm)
    return found.withColumn("similarity", F.round("similarity", 6))


def ledger_convention(spark, sf_dir):
    bank, ledger = _sides(spark, sf_dir)
    turned = ledger.withColumn("amount", (-F.col("amount")).cast("decimal(18,2)"))
    return semantic.choose_convention(bank, {"debit_is_inflow": turned, "credit_is_inflow": ledger})


def _lines(spark, sf_dir):
    """A laid-out statement per customer, with wrapped narrations, a repeated header and totals."""
    rows = projection.payments(spark, sf_dir)
    w = Window.partitionBy("customer").orderBy("d", "k")
    rows = rows.withColumns({"n": F.row_number().over(w), "balance": F.sum("a").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("decimal(18,2)")})
    figure = lambda c, width: F.lpad(c, width, " ")
    debit = F.when(F.col("a") < 0, (-F.col("a")).cast("string")).otherwise("")
    credit = F.when(F.col("a") > 0, F.col("a").cast("string")).otherwise("")
    body = F.concat(F.date_format("d", "dd/MM/yyyy"), F.lit("  "), F.rpad(F.concat(F.lit("NEFT/N"), F.lpad(F.col("k").cast("string"), 8, "0"), F.lit("/"), F.upper("p")), 34, " "), F.rpad(F.concat(F.lit("N"), "k"), 14, " "), figure(debit, 16), figure(credit, 16), figure(F.col("balance").cast("string"), 18))
    more = F.concat(F.lit(" " * 12), F.lit("invoice "), "p")
    header = f"{'Date':<12}{'Narration':<34}{'Chq./Ref.No.':<14}{'Withdrawal Amt':>16}{'Deposit Amt':>16}{'Closing Balance':>18}"
    each = rows.select("customer", F.col("n").alias("row"), F.explode(F.when(F.col("k") % 3 == 0, F.array(F.struct(F.lit(1).alias("part"), body.alias("text")), F.struct(F.lit(2).alias("part"), more.alias("text")))).otherwise(F.array(F.struct(F.lit(1).alias("part"), body.alias("text"))))).alias("x")).select("customer", "row", "x.*")
    again = rows.where("n % 20 = 0").select("customer", F.col("n").alias("row"), F.lit(3).alias("part"), F.lit(header).alias("text"))
    top = rows.where("n = 1").select("customer", F.lit(0).alias("row"), F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("Statement of account    Opening Balance : 0.00").alias("text")), F.struct(F.lit(1).alias("part"), F.lit(header).alias("text")))).alias("x")).select("customer", "row", "x.*")
    lines = each.unionByName(again).unionByName(top)
    place = F.row_number().over(Window.partitionBy("customer").orderBy("row", "part"))
    return lines.select(F.col("customer").cast("string").alias("file_name"), place.alias("line_no"), F.lit(1).alias("page"), "text")


def _page_rows(spark, sf_dir):
    """A printed row for each payment, thirty to a page, with its narration set lower than its figures."""
    w = Window.partitionBy("customer").orderBy("d", "k")
    rows = projection.payments(spark, sf_dir).withColumn("n", F.row_number().over(w) - 1)
    figure = F.abs("a").cast("string")
    balance = F.when(F.col("k") % 7 == 0, figure).otherwise(((F.col("k") * 13 % 100_000) / 100).cast("decimal(18,2)").cast("string"))
    rows = rows.select(
        F.col("customer").cast("string").alias("doc"), (F.floor(F.col("n") / 30) + 1).cast("long").alias("page"), F.col("k").alias("line"), (100 + F.col("n") % 30 * 15).cast("double").alias("top"),
        F.date_format("d", "dd/MM/yyyy").alias("date"), F.concat(F.lit("N"), "k").alias("reference"), F.when(F.col("a") < 0, figure).alias("debit"), F.when(F.col("a") >= 0, figure).alias("credit"), balance.alias("balance"), F.upper("p").alias("party"),
    )
    rows = keep_rows(rows, "page-rows")
    parts = ((F.col("date"), 40, 95, 0), (F.lit("NEFT"), 100, 130, 4), (F.col("party"), 135, 180, 4), (F.col("reference"), 250, 300, 0), (F.col("debit"), 350, 400, 0), (F.col("credit"), 450, 500, 0), (F.col("balance"), 550, 600, 0))
    each = F.array(*[F.struct((F.col("line") * 8 + i).alias("word"), t.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(z)).alias("x1"), (F.col("top") + dy).alias("top")) for i, (t, x, z, dy) in enumerate(parts)])
    words = rows.select("doc", "page", F.explode(each).alias("w")).select("doc", "page", "w.*").where("text IS NOT NULL")
    words = words.withColumns({"bottom": F.col("top") + 8, "width": F.lit(612.0), "height": F.lit(792.0)})
    return rows.withColumn("text", F.concat_ws("   ", *[t for t, *_ in parts])), words


def locate_lines(spark, sf_dir):
    found = geometry.located_lines(*_page_rows(spark, sf_dir))
    return found.select("doc", "page", "line", "height", "score", "words", *[F.round(c, 6).alias(c) for c in geometry.EDGES])


def cell_boxes(spark, sf_dir):
    rows, words = _page_rows(spark, sf_dir)
    found = geometry.cell_boxes(rows, geometry.located_words(rows, words))
    return found.select("doc", "page", "line", "field", *[F.round(c, 6).alias(c) for c in geometry.EDGES])


def layout_parse(spark, sf_dir):
    """Statements written as aligned lines, read back by geometry and audited."""
    from .sources import layout

    rows = layout.transactions(_lines(spark, sf_dir), "bank", "pnb")
    return rows.select("file_name", "ord", "date", "amount", "description", "reference", F.array_join("alt_references", ",").alias("alt"), "status")


def sheet_ingest(spark, sf_dir):
    """The ledger written as a CSV sheet, read back, its columns found by their headers."""
    from .shared import shared_path
    from .sources import sheets

    rows = projection.ledger(spark, sf_dir)
    path = shared_path(spark, "sheet")
    rows.select(F.date_format("date", "dd-MM-yyyy").alias("Txn Date"), F.col("description").alias("Particulars"), F.col("reference").alias("Voucher No."), F.format_number("amount", 2).alias("Amount")).write.option("header", True).csv(path)
    found = sheets.normalize(sheets.read_csv(spark, path), "ledger")
    return found.groupBy("date", "amount", "description", "reference").agg(F.count("*").alias("n"))


def workbook_ingest(spark, sf_dir):
    """The ledger written as two workbooks of different headers beside one without money, and read back."""
    from .shared import shared_path
    from .sources import sheets, workbooks

    rows, folder = projection.ledger(spark, sf_dir), shared_path(spark, "workbooks")
    said = lambda rows, *money: rows.select(F.col("ord"), F.date_format("date", "dd-MM-yyyy").alias("Txn Date"), F.col("description").alias("Particulars"), F.col("reference").alias("Voucher No."), *money)
    one = said(rows.where("ord % 8 = 0"), F.col("amount").alias("Amount"))
    two = said(rows.where("ord % 8 <> 0"), F.when(F.col("amount") < 0, -F.col("amount")).alias("Withdrawal"), F.when(F.col("amount") >= 0, F.col("amount")).alias("Deposit"))
    import os

    os.makedirs(folder.removeprefix("file://"), exist_ok=True)
    for name, frame in (("one", one), ("two", two.withColumnsRenamed({"Txn Date": "Date", "Particulars": "Narration"})), ("none", said(rows.limit(3)))):
        workbooks.write_workbook({"Ledger": frame}, f"{folder}/{name}.xlsx", {"Ledger": ["ord"]})
    found = sheets.read_transactions(spark, f"{folder}/*.xlsx", "ledger")
    return found.groupBy("date", "amount", "description", "reference").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        summary, bank_transactions, ledger_transactions, fee_gap, distinctive_tokens, token_dice, reference_match, citation_label, narration_parse,
        match_exact_candidates, match_exact, corroboration_mix, unmatched_bank, unmatched_ledger, near_candidates, match_near, unexplained, recon_identity, completeness, stage1_exact,
        dup_payments, dup_rows, summary_sheet, threshold_avoidance, round_numbers, mirrored_entries, timing_gaps, dup_collapsed, anomaly_report, anomaly_rows_all, run_payload, headline, model_rows, model_answers, match_hot_amounts, match_issues, _review("amount"), _review("date"), _review("weak"), classify_unmatched,
        balance_audit, footing_check, client_activity, run_history, retention_purge, cosine_topk, semantic_match, ledger_convention, layout_parse, locate_lines, cell_boxes, sheet_ingest, workbook_ingest,
    )
}
