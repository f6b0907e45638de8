"""Raw job postings derived from the driver's order tables.

The reference's inputs are five scraped CSV files that are not public; these
adapters derive equivalent raw inputs (every salary, country, job-type and
null rule occurs) from ``orders ⋈ customer ⋈ nation`` so that all work grows
with the tables. The same derivation is written in SQL for the oracle.

Plan at scale: orders (the fact table) is the probe side of a join with
customer (a shuffle join at scale, a broadcast when the planner's size check
allows) and then with nation (a 25-row dimension, broadcast); only 4+3+2
columns are read from the three scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.session import read_table


def _sql_text(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pick(key, modulus: int, values) -> Column:
    """CASE pmod(key, modulus) WHEN i THEN values[i] ... END (None -> NULL).

    With a column name and values that are literals or ``SQL(...)`` fragments,
    the CASE is one SQL expression (one call to build); with Column values it
    is composed node by node."""
    if isinstance(key, str) and not any(isinstance(v, Column) for v in values):
        whens = " ".join(
            f"WHEN {i} THEN {'CAST(NULL AS STRING)' if v is None else (v.text if isinstance(v, SQL) else _sql_text(v))}"
            for i, v in enumerate(values))
        return F.expr(f"CASE pmod(`{key}`, {modulus}) {whens} END")
    k = F.col(key) if isinstance(key, str) else key
    m = F.pmod(k, F.lit(modulus))
    expr = None
    for i, v in enumerate(values):
        val = v if isinstance(v, Column) else F.lit(v).cast("string")
        expr = F.when(m == i, val) if expr is None else expr.when(m == i, val)
    return expr


class SQL:
    """A Spark SQL fragment used as a ``_pick`` value."""

    def __init__(self, text: str):
        self.text = text


def _orders_customer_nation(spark: SparkSession, sf_dir: str, order_cols, many: bool = False) -> DataFrame:
    """orders ⋈ customer ⋈ nation, fact table first: the dimensions are the
    build sides (broadcast when the planner's size check allows, shuffle
    join otherwise) and the probe side keeps the orders partitioning.

    ``many``: for callers that write the join in several jobs. The customers are
    then shuffled, as each job's broadcast would take all of them through the driver."""
    orders = read_table(spark, sf_dir, "orders").select(*order_cols)
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = orders.join(customer.hint("merge") if many else customer, orders.o_custkey == customer.c_custkey, "inner")
    return j.join(nation, j.c_nationkey == nation.n_nationkey, "inner")


def raw_jobs(spark: SparkSession, sf_dir: str, many: bool = False) -> DataFrame:
    """One raw posting per order (FIXTURES.md section 5); ``job_id`` is unique."""
    j = _orders_customer_nation(spark, sf_dir, ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"], many)
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    salary = _pick("o_orderkey", 13, [
        None,
        "Gaji Tidak Ditampilkan",
        "6,5 jt - 7,5 jt",
        "5 jt",
        SQL("concat('Rp ', CAST(pmod(o_orderkey, 9) + 1 AS STRING), '.000.000 - Rp 12.500.000')"),
        "$1,000 - $2,000",
        "Rp 3,000,000",
        "500 rb - 700",
        "5 - 10 rb",
        "Rp 50.000 per jam",
        "10.000.000 ₫",
        "5 million",
        "SGD 5k – 7k",
    ])
    return j.select(
        ok.alias("job_id"),
        _pick("o_orderkey", 4, ["Data Engineer", "Web Developer", "QA Engineer", "Data Analyst"]).alias("job_title"),
        F.when(F.pmod(ck, F.lit(11)) == 0, F.lit(None).cast("string"))
         .otherwise(F.col("c_name")).alias("company_name"),
        _pick("o_custkey", 7, [None, "Nusa Dua, Bali", "London, Singapore", "Indianapolis", "Jakarta",
                               "Manila", SQL("concat('TOKYO ', n_name)")]).alias("location"),
        _pick("o_orderkey", 9, [None, "Penuh Waktu", "Kontrak", "International", "Freelance", "part-time",
                                "Remote", "Full-time contract", "Shift"]).alias("job_type_raw"),
        _pick("o_orderkey", 6, [None, " Apa Saja ", "tidak diketahui", " 1 - 3 tahun", "3 Tahun",
                                "Fresh Graduate"]).alias("experience_raw"),
        _pick("o_custkey", 4, [None, "S1", "Tidak Disebutkan", "SMA "]).alias("education_raw"),
        _pick("o_orderkey", 8, [None, "0", "abc"] + [SQL("CAST(pmod(o_orderkey, 8) AS STRING)")] * 5
              ).alias("experience_years_raw"),
        salary.alias("salary_raw"),
        _pick("o_orderkey", 3, ["<p>SQL &amp; Spark</p>", None, "<b>Python</b>  <i>remote</i>"]).alias("skills_html"),
        F.col("o_orderpriority").alias("keyword"),
        _pick("o_orderkey", 5, ["Glints", "Karir.com", "LinkedIn", "Tech In Asia", "Indeed"]).alias("platform"),
        F.when(F.pmod(ok, F.lit(10)) == 0, F.lit(None).cast("string"))
         .otherwise(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")).alias("post_date_raw"),
    )


# Per-source raw frames: the adapter filtered by platform and renamed to each
# scraper's own columns (D1-D5). Columns a source does not have are absent.
SOURCE_COLUMNS = {
    "Glints": [
        ("job_title", "Judul Posisi"), ("company_name", "Nama Perusahaan"),
        ("location", "Lokasi"), ("job_type_raw", "Tipe Pekerjaan"),
        ("experience_raw", "Pengalaman"), ("education_raw", "Pendidikan"),
        ("salary_raw", "Gaji"), ("post_date_raw", "Tanggal Posting"), ("keyword", "Keyword"),
    ],
    "Karir.com": [
        ("job_title", "job_title"), ("company_name", "company_name"), ("location", "location"),
        ("job_type_raw", "job_type"), ("experience_raw", "experience_level"),
        ("education_raw", "education_req"), ("salary_raw", "salary_range"),
        ("skills_html", "job_requirements"), ("post_date_raw", "posted_date"),
        ("platform", "source_platform"),
    ],
    "LinkedIn": [
        ("keyword", "searched_keyword"), ("job_title", "job_title"),
        ("company_name", "company_name"), ("location", "location"),
        ("post_date_raw", "posted_date"), ("platform", "source_platform"),
    ],
    "Tech In Asia": [
        ("job_title", "job_title"), ("company_name", "company_name"), ("location", "location"),
        ("skills_html", "skills_required"), ("experience_years_raw", "experience_years_min"),
        ("job_type_raw", "job_type"), ("post_date_raw", "published_at"),
        ("platform", "source_platform"),
    ],
    "Indeed": [
        ("job_title", "job_title"), ("company_name", "company_name"), ("location", "location"),
        ("job_type_raw", "job_type"), ("experience_raw", "experience"),
        ("education_raw", "education"), ("salary_raw", "salary_raw"),
        ("skills_html", "skills"), ("keyword", "keyword"), ("post_date_raw", "post_date"),
        ("platform", "platform"),
    ],
}


def source_frame(raw: DataFrame, platform: str, keep_id: bool = True) -> DataFrame:
    """The adapter's rows of one platform, in that scraper's own columns."""
    cols = [F.col(a).alias(b) for a, b in SOURCE_COLUMNS[platform]]
    if keep_id:
        cols = [F.col("job_id")] + cols
    return raw.where(F.col("platform") == platform).select(*cols)


def source_frame_full(raw: DataFrame, platform: str, schema) -> DataFrame:
    """``source_frame`` with every column of the scraper's schema (absent
    ones null), i.e. the file that scraper writes."""
    have = dict((b, a) for a, b in SOURCE_COLUMNS[platform])
    cols = [F.col("job_id")] + [
        (F.col(have[f.name]) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields]
    return raw.where(F.col("platform") == platform).select(*cols)


def karir_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows of the Karir API (one per order): id, title, company,
    location, salary bounds, ISO timestamp. Some bounds are null or 0."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
    ok = F.col("o_orderkey")
    lower = F.floor(F.col("o_totalprice") / 100).cast("bigint") * 1000
    return j.select(
        ok.alias("id"),
        F.concat(F.lit("<b>"), _pick(ok, 4, ["Data Engineer", "Web Developer", "QA Engineer",
                                             "Data Analyst"]), F.lit("</b>&nbsp;")).alias("job_position"),
        F.col("c_name").alias("company_name"),
        F.concat(F.lit("Kota "), F.col("o_orderstatus")).alias("location_name"),
        F.when(F.pmod(ok, F.lit(3)) == 0, F.lit(None).cast("bigint"))
         .when(F.pmod(ok, F.lit(3)) == 1, F.lit(0).cast("bigint"))
         .otherwise(lower).alias("salary_lower"),
        (lower * 2).alias("salary_upper"),
        F.when(F.pmod(ok, F.lit(7)) == 0, F.lit(None).cast("string"))
         .otherwise(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss")).alias("posted_at"),
    )


def karir_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail rows of the Karir API, one per order that has line items.

    Built by one aggregation of lineitem on its order key (partial aggregation
    map-side, then a shuffle of one row per order and map task)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    g = li.groupBy("l_orderkey").agg(
        F.max("l_linenumber").alias("n_lines"),
        F.sort_array(F.collect_set("l_returnflag")).alias("flags"),
        F.min("l_linestatus").alias("status"),
        F.sum("l_quantity").alias("qty"),
    )
    k = F.col("l_orderkey")
    return g.select(
        k.alias("id"),
        F.when(F.pmod(k, F.lit(4)) == 0, F.lit(None).cast("string"))
         .when(F.pmod(k, F.lit(4)) == 1, F.lit(""))
         .otherwise(F.concat(F.lit("Gedung "), F.col("status"))).alias("location"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("<p>Kontrak</p>"), F.lit("&amp; "), F.col("status"))).alias("job_type"),
        F.when(F.pmod(k, F.lit(6)) == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("n_lines").cast("bigint")).alias("work_experience"),
        F.transform(F.col("flags"), lambda f: F.concat(F.lit("S"), f)).alias("degrees"),
        F.concat(F.lit("<ul><li>"), F.floor(F.col("qty")).cast("string"),
                 F.lit(" unit</li>  <li>&quot;SQL&quot;</li></ul>")).alias("requirements"),
        F.when(F.pmod(k, F.lit(2)) == 0, F.lit("<p></p>"))
         .otherwise(F.lit("<p>Build &amp; ship</p>")).alias("responsibilities"),
    )


def _hit_sql(k: str) -> str:
    """Spark SQL text building the JSON of one search hit; ``k`` (an integer
    expression) picks which optional shapes occur."""
    t = "concat('Engineer ', o_orderpriority)"
    return f"""concat('{{',
 CASE pmod({k}, 4) WHEN 0 THEN concat('"title":null,"name":"Alt ', {t}, '",')
   WHEN 1 THEN concat('"title":"","name":"Alt ', {t}, '",') WHEN 2 THEN concat('"title":"', {t}, '",') ELSE '' END,
 CASE pmod({k}, 4) WHEN 0 THEN concat('"company":{{"name":"', c_name, '"}},') WHEN 1 THEN '"company":{{}},'
   WHEN 2 THEN '"company":null,' ELSE '"company":{{"name":null}},' END,
 CASE pmod({k}, 2) WHEN 0 THEN concat('"city":{{"country_name":"', n_name, '"}},') ELSE '"city":{{"country_name":null}},' END,
 CASE pmod({k}, 3) WHEN 0 THEN '"work_country_name":"Singapore",' ELSE '' END,
 CASE pmod({k}, 3) WHEN 0 THEN '"job_type":{{"name":"Full-time"}},' WHEN 1 THEN '"job_type":"Kontrak",' ELSE '' END,
 CASE pmod({k}, 3) WHEN 0 THEN '"job_skills":[{{"name":"SQL"}},{{"name":"Spark"}}],'
   WHEN 1 THEN '"job_skills":[],"skills":[{{"name":"Python"}},"Go"],' ELSE '' END,
 CASE WHEN pmod({k}, 7) = 0 THEN '' ELSE concat('"experience_min":', CAST(pmod({k}, 5) AS STRING), ',') END,
 CASE WHEN pmod({k}, 10) = 0 THEN '"published_at":null'
   ELSE concat('"published_at":"', date_format(o_orderdate, 'yyyy-MM-dd'), '"') END,
 '}}')"""


def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search-API response per order with two hits built from the order,
    its customer and nation (JSON text, as the API returns it)."""
    j = _orders_customer_nation(spark, sf_dir, ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    payload = F.expr(f"""concat('{{"results":[{{"hits":[', {_hit_sql("o_orderkey")}, ',',
                                {_hit_sql("(o_orderkey + 1)")}, ']}}]}}')""")
    k = F.col("o_orderkey")
    return j.select(k.alias("payload_id"), payload.alias("payload"))


def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of the job boards, built from ``orders``: each order is one
    card of one of four markups (board = order key mod 4), ten or so cards of a
    customer make a page; some cards lack optional parts or wear look-alike
    class names, some have an opening tag of over 400 characters, some pages are
    challenge pages without cards."""
    k = "o_orderkey"
    link = f"CASE WHEN {k} % 9 = 0 THEN concat('data-link=\"/rc/clk?q=', repeat('x', 450), '\" ') ELSE '' END"
    title = f"CASE {k} % 5 WHEN 0 THEN concat('<h2 class=\"jobTitle css-1h\"><span title=\"Role ', {k}, '\">Role ', {k}, '</span></h2>')" \
            f" WHEN 1 THEN concat('<a class=\"jcs-JobTitle\" href=\"/rc/', {k}, '\">Role ', {k}, '</a>')" \
            f" WHEN 2 THEN concat('<h2 class=\"title\"><a href=\"https://ex.org/', {k}, '\"> Role ', {k}, ' </a></h2>')" \
            f" WHEN 3 THEN concat('<a data-jk=\"', {k}, '\" href=\"/viewjob?jk=', {k}, '\"><span>Role ', {k}, '</span></a>') ELSE '' END"
    indeed = f"""concat('<div ', {link}, 'class="', CASE {k} % 11 WHEN 0 THEN 'not-job_seen_beacon' ELSE 'cardOutline job_seen_beacon tapped' END, '">',
      {title},
      CASE WHEN {k} % 3 = 0 THEN '' ELSE concat('<span data-testid="company-name">', concat('PT &amp; ', o_orderstatus), '</span>') END,
      CASE WHEN {k} % 7 = 0 THEN '<div class="companyLocation">Remote in Jakarta</div>' WHEN {k} % 2 = 0 THEN '<div data-testid="text-location">Bandung</div>' ELSE '' END,
      CASE {k} % 4 WHEN 0 THEN '<div class="salary-snippet-container">Rp 5 jt</div>' WHEN 1 THEN '<span class="salaryText"> Rp 7 jt </span>' ELSE '' END,
      CASE WHEN {k} % 6 = 0 THEN '<span class="date">Posted 3 days ago</span>' ELSE '' END,
      '<div class="job-snippet">Work ', CASE WHEN {k} % 13 = 0 THEN 'from home &amp; more' ELSE o_orderpriority END, '</div></div><!--card-->')"""
    old = f"""concat('<div class=\\'row jobsearch-SerpJobCard\\'><h2 class="title"><a href="/old/', {k}, '">Old role ', {k}, '</a></h2></div><!--card-->')"""
    glints = f"""concat('<div ', {link}, 'class="JobCard"><h3>Role ', {k}, '</h3>',
      CASE WHEN {k} % 3 = 0 THEN '' ELSE concat('<a data-testid="company">', CASE WHEN {k} % 5 = 0 THEN '  ' ELSE concat('PT &amp; ', o_orderstatus) END, '</a>') END,
      '<span class="tag">\\n\\t</span><span class="tag">Penuh Waktu</span>', CASE WHEN {k} % 2 = 0 THEN '<span class="tag">1 - 3 tahun</span><span class="tag">S1</span>' ELSE '<span class="tag">+2</span>' END,
      '<a class="card-link" href="/jobs/', {k}, '">x</a></div><!--card-->')"""
    linkedin = f"""concat('<li><div class="base-card"><a class="base-card__full-link" href="https://li.example/', {k}, '"></a><h3 class="base-search-card__title"> Role ', {k}, '</h3>',
      CASE WHEN {k} % 4 = 0 THEN '' ELSE concat('<h4 class="base-search-card__subtitle"><a>', concat('PT &amp; ', o_orderstatus), '</a></h4>') END,
      '<span class="job-search-card__location">Jakarta</span>', CASE WHEN {k} % 3 = 0 THEN '' ELSE concat('<time datetime="', date_format(o_orderdate, 'yyyy-MM-dd'), '"></time>') END, '</div></li><!--card-->')"""
    card = f"CASE o_custkey % 4 WHEN 0 THEN {indeed} WHEN 1 THEN {old} WHEN 2 THEN {glints} ELSE {linkedin} END"
    # look-alikes stand before the first card, where no card's markup holds them
    cards = read_table(spark, sf_dir, "orders").select(
        "o_custkey", F.expr("o_custkey % 4 <> 0 OR o_orderkey % 11 <> 0").alias("real"), "o_orderkey", F.expr(card).alias("card"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("real", "o_orderkey", "card"))), lambda x: x["card"]), "\n")
    page = cards.groupBy("o_custkey").agg(body.alias("body"))
    # every 17th page is a challenge page, every 19th one without cards or marker
    html = (F.when(F.col("o_custkey") % 17 == 0, "<title>Security Check</title><p>Captcha</p>")
            .when(F.col("o_custkey") % 19 == 0, "<p>No results</p>").otherwise(F.col("body")))
    return page.select(
        F.col("o_custkey").alias("page_id"), html.alias("html"),
        F.concat(F.lit("https://board"), (F.col("o_custkey") % 4).cast("string"), F.lit(".example/jobs?q=x&page="),
                 (F.col("o_custkey") % 3).cast("string")).alias("url"))


def nested_card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages with nested markup, one page a customer and one card an order:
    tags inside titles, companies and locations, a card inside every seventh card,
    stray end tags, and card markup in comments and scripts."""
    k = "o_orderkey"
    card = f"""concat('<div class="x job_seen_beacon">',
      CASE {k} % 4 WHEN 0 THEN concat('<h3 class="jobTitle"><a class="jcs-JobTitle" href="/rc/', {k}, '"><span title="Role ', {k}, ' &amp; more">Role <b>', {k}, '</b></span></a></h3>')
        WHEN 1 THEN concat('<h2 class=\\'jobTitle css\\'><span>Lead <em>role</em> ', {k}, '</span></h2>')
        WHEN 2 THEN concat('<h3 class="jobTitle"><a data-jk="', {k}, '" href="https://ex.org/?a=1&amp;k=', {k}, '"><span>Plain ', {k}, '</span></a></h3>') ELSE '<h3>no title</h3>' END,
      CASE WHEN {k} % 3 = 0 THEN '' ELSE concat('<span data-testid="company-name">PT <i>', o_orderstatus, '</i></span>') END,
      CASE WHEN {k} % 5 = 0 THEN '<div data-testid="text-location">Remote in <b>Jakarta</b></div></section>' ELSE '<!-- <div data-testid="text-location">x</div> -->' END,
      CASE WHEN {k} % 2 = 0 THEN '<div class="metadata salary-snippet-container"><span>Rp 5</span> jt</div>' ELSE '' END,
      CASE WHEN {k} % 6 = 0 THEN '<span class="date">Posted</span>' ELSE '' END,
      '<div class="job-snippet"><ul><li>Work ', o_orderpriority, '</li><li>daily<br>tasks</ul></div>',
      CASE WHEN {k} % 7 = 0 THEN concat('<div class="job_seen_beacon"><h2 class="jobTitle"><span title="Inner ', {k}, '">x</span></h2><span class="date">today</span></div>') ELSE '' END, '</div>')"""
    cards = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr(card).alias("card"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "card"))), lambda x: x["card"]), "\n")
    html = F.concat(F.lit("<html><body></p><script>var c = '<div class=\"job_seen_beacon\">';</script>"), body, F.lit("</body>"))
    return cards.groupBy("o_custkey").agg(html.alias("html")).select(
        F.col("o_custkey").alias("page_id"), F.concat(F.lit("https://board.example/"), "o_custkey").alias("url"), "html")


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a streaming source (parquet file source,
    schema taken from the table; only ``events.parquet`` in the folder)."""
    schema = read_table(spark, sf_dir, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .parquet(sf_dir).select(*EVENT_COLUMNS))


def job_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``job_event_rows_from`` over the events table (batch)."""
    return job_event_rows_from(read_table(spark, sf_dir, "events").select(*EVENT_COLUMNS))


def job_event_rows_from(ev: DataFrame) -> DataFrame:
    """D8 job events derived from ``events`` rows, batch or streaming
    (``event_type`` -> platform, ``user_id`` -> keyword, ``ts`` -> event
    time), with the stream's awkward cases: null platform / keyword /
    country, missing salaries, and unparsable event times. ``job_url``
    carries the event id."""
    from jobsight.streaming.events import iso_utc

    e, u = F.col("event_id"), F.col("user_id")
    salary = F.when(F.pmod(e, F.lit(5)) == 0, F.lit(None).cast("double")).otherwise(F.col("value") * 1_000_000.0)
    return ev.select(
        e.alias("event_id"),
        F.concat(F.lit("Job "), F.col("event_type")).alias("job_title"),
        F.concat(F.lit("Company "), F.pmod(u, F.lit(50)).cast("string")).alias("company_name"),
        _pick(e, 4, [None, "Jakarta", "Manila", "TOKYO"]).alias("location"),
        F.when(F.pmod(e, F.lit(7)) == 0, F.lit(None).cast("string"))
         .otherwise(_pick(e, 4, [None, "Indonesia", "Philippines", "Japan"])).alias("country"),
        F.lit("Full-time").alias("job_type"),
        F.lit("Tidak dicantumkan").alias("experience"),
        F.lit("Tidak dicantumkan").alias("education"),
        salary.alias("salary_min"),
        (salary * 2).alias("salary_max"),
        F.when(F.pmod(u, F.lit(13)) == 0, F.lit(None).cast("string")).otherwise(u.cast("string")).alias("keyword"),
        F.when(F.pmod(e, F.lit(11)) == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("platform"),
        F.date_format(F.col("ts"), "yyyy-MM-dd").alias("post_date"),
        F.concat(F.lit("event://"), e.cast("string")).alias("job_url"),
        F.when(F.pmod(e, F.lit(17)) == 0, F.lit("not-a-time")).otherwise(iso_utc(F.col("ts"))).alias("event_time"),
    )


def job_event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``job_event_values_from`` over the events table (batch)."""
    return job_event_values_from(job_event_rows(spark, sf_dir))


def job_event_values_from(rows: DataFrame) -> DataFrame:
    """The topic's message values: JSON text per event; every 19th message is
    malformed (not JSON). Works on a batch or a streaming frame."""
    from jobsight.streaming.events import to_events

    rows = rows.withColumn("_bad", F.pmod(F.col("event_id"), F.lit(19)) == 0)
    ev = to_events(rows, event_time=F.col("event_time"), keep=["_bad"])
    return ev.select(F.when(F.col("_bad"), F.lit("garbage{")).otherwise(F.col("value")).alias("value"))
