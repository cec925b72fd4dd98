"""The products on landed rows, with the edge rows of their inputs."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from civisight import rules
from civisight.operators import classify
from civisight.plans import alignment, budget, cards, clippings, corpus, monitors, registry, requests, sanctions

D = dt.date


def rows(spark, columns, *values):
    names = [c.strip() for c in columns.split(",")]
    return spark.createDataFrame([tuple(v) for v in values], ", ".join(f"`{n}` string" for n in names))


def numbered(df):
    return df.withColumn("row_no", F.monotonically_increasing_id()).coalesce(1)


def test_alignment(spark):
    events = alignment.landed_events(rows(
        spark, "id,idOrgao,data,dataHoraRegistro,descricao,aprovacao,uri,ultimaApresentacaoProposicao_uriProposicao",
        ("e1", "180", "2019-02-01", "t", "Requerimento de urgência", "", "u", "p"), ("e2", "180", "2019-04-10", "t", "Projeto", "", "u", "p"),
        ("e3", "180", "2019-04-11", "t", "Sem orientação", "", "u", "p"), ("e4", "99", "2019-04-11", "t", "Outro órgão", "", "u", "p"), ("e5", "180", "bad", "t", "Sem data", "", "u", "p")))
    advice = alignment.landed_advice(spark.createDataFrame(
        [("e1", "Governo", "Sim", 1), ("e1", "Governo", "NÃO", 2), ("e1", "Governo", "", 3), ("e2", "GOVERNO", "Sim", 4), ("e2", "Minoria", "Não", 5), ("e4", "Governo", "Sim", 6), ("e5", "Governo", "Sim", 7)],
        "idVotacao string, siglaBancada string, orientacao string, row_no int"))
    votes = alignment.landed_votes(spark.createDataFrame([
        ("e1", "sim", "1", "Ana", "PX", "SP", 1), ("e1", "NAO", "1", "Ana", "PX", "SP", 2),       # the second vote of a person is ignored
        ("e1", "não", "2", "Bia", "PY", "RJ", 3), ("e1", "Blanco", "", "Caio", "", "", 4),         # unknown value and empty id
        ("e2", "Sim", "1", "Ana", "", "", 5), ("e2", "Art. 17", "2", "Bia", "PZ", "", 6), ("e3", "Sim", "1", "Ana", "PX", "SP", 7), ("e9", "Sim", "1", "Ana", "PX", "SP", 8),
        ("e2", "", "3", "Davi", "PX", "SP", 9),
    ], "idVotacao string, voto string, deputado_id string, deputado_nome string, deputado_siglaPartido string, deputado_siglaUf string, row_no int"))
    expected = {
        ("e1", "1", "PX", "SP", "Sim", False), ("e1", "2", "PY", "RJ", "Não", True), ("e1", "name::Caio", "Sem partido", "--", "Blanco", False),
        ("e2", "1", "PX", "SP", "Sim", True), ("e2", "2", "PZ", "RJ", "Artigo 17", False),
    }
    for shuffled in (votes, votes.orderBy(F.rand(1)), votes.repartition(7)):        # only row_no decides
        got = alignment.aligned_votes(shuffled, events, advice, fill_labels=True, chunk=F.floor(F.col("row_no") / 2))
        assert {(r.event_id, r.person_id, r.group, r.state, r.value, r.pro) for r in got.collect()} == expected
    tallies = alignment.event_tallies(got)
    assert {(r.event_id, r.kind, r.period) for r in tallies.collect()} == {("e1", "procedural", "bolsonaro"), ("e2", "merit", "bolsonaro")}
    months = alignment.monthly_filled(tallies).orderBy("month").collect()
    assert [(r.month, r.total, r.pct, r.has_rows) for r in months] == [(D(2019, 2, 1), 3, 1 / 3 * 100, True), (D(2019, 3, 1), 0, None, False), (D(2019, 4, 1), 2, 50.0, True)]
    assert all(r.pro + r.anti == r.total for r in alignment.time_cube(tallies).collect())
    assert {r.person_id: (r.group, r.state) for r in alignment.person_directory(got).collect()}["name::Caio"] == ("Sem partido", "--")


THEMES = [("Pessoal", ["cpf", "dado pessoal"]), ("Contratos", ["contrato", "cpf"])]


def test_requests(spark):
    raw = rows(spark, ",".join(requests.LANDED),
               ("1", "7", "03/02/2020 10:00:00", "Saúde", "", "Contrato e CPF", "", "", "Acesso negado  por sigilo", "dado pessoal", "", None),
               ("2", "0", "31/02/2020", "Saúde", "", "pedido", "", "", "", "", "", "informação inexistente"),
               ("3", "8", "2020-03-01", "", "", "contrato", "", "", "Acesso Parcialmente Concedido", "x" * 181, "", None),
               ("4", "8", "05/03/2020", "Fazenda", "", "nada", "", "", "y" * 121, "lgpd e honra", "", None))
    got = {r.id: r for r in requests.landed_requests(raw, THEMES, 2020).collect()}
    assert (got["1"].decision, got["1"].reason, got["1"].theme, got["1"].is_personal) == (rules.DENIED, "Dados pessoais", "Pessoal", True)
    assert (got["2"].decision, got["2"].requester, got["2"].month, got["2"].reason) == (rules.NO_DECISION, None, None, "Informação inexistente")
    assert (got["3"].body, got["3"].reason, got["3"].is_restricted, got["3"].is_denied, got["3"].theme) == (None, rules.FREE_TEXT, True, False, "Contratos")
    assert (got["4"].decision, got["4"].reason, got["4"].is_personal, got["4"].theme) == (rules.FREE_TEXT, "Lgpd e honra", False, rules.OTHER_THEMES)
    cube = requests.request_counts(requests.landed_requests(raw, THEMES, 2020))
    count = lambda grain: sum(r.total for r in cube.filter(F.col("grain") == grain).collect())
    assert [count(g) for g in ("year", "month", "body", "body_month", "theme")] == [4, 3, 3, 2, 4]
    assert requests.monthly_grid(cube).count() == 12


def test_dominant_requester(spark):
    base = spark.createDataFrame(
        [("B", 2020, f"r{i}", i < 10) for i in range(140)] + [("B", 2020, "hot", True)] * 100 + [("B", 2021, "x", False)] * 5 + [("C", 2020, "y", True)] * 3,
        "body string, year int, requester string, is_denied boolean")
    got = {r.body: r for r in requests.body_concentration(base).collect()}
    assert (got["B"].year, got["B"].concentrated) == (2021, False)           # a later year overwrites
    only = {r.body: r for r in requests.body_concentration(base.filter("year = 2020")).collect()}
    assert (only["B"].concentrated, only["B"].flagged_id, only["B"].denied_rate_adjusted) == (True, "hot", 10 / 140)
    assert (only["C"].concentrated, only["C"].denied_rate_adjusted) == (False, 1.0)


def test_attachments(spark):
    files = spark.createDataFrame([("1", "Anexo", "http://a", 1), ("1", "Resposta", "http://b", 2), ("1", "Resposta", "http://c", 3), ("2", "Pedido", "ftp", 1)],
                                  "IdPedido string, TipoAnexo string, UrlArquivo string, row_no int")
    assert [tuple(r) for r in requests.best_attachments(files).collect()] == [("1", "http://b")]


def test_budget(spark):
    docs = budget.landed_documents(rows(
        spark, "data_documento,nome_do_autor_da_emenda,localidade_de_aplicacao_do_recurso,municipio_de_aplicacao_do_recurso,uf_de_aplicacao_do_recurso,valor_empenhado,valor_pago",
        ("03/01/2024", "Ana", "", "Recife", "PE", "R$ 1.000,50", "-"), ("03/01/2024", "", "Nacional", "", "", "-10,00", "5"), ("01/01/2024", "Bia", "", "", "", "0", "2,5"), ("x", "Bia", "", "", "", "9", "")))
    assert {r.place for r in docs.collect()} == {"Recife - PE", "Nacional", budget.NO_PLACE}
    series = budget.daily_series(docs).orderBy("day").collect()
    assert [(str(r.day), float(r.committed), float(r.committed_running), float(r.paid_running)) for r in series] == [
        ("2024-01-01", 0.0, 0.0, 2.5), ("2024-01-02", 0.0, 0.0, 2.5), ("2024-01-03", 1000.5, 1000.5, 7.5)]
    members = rows(spark, "name,party", ("ANA", "PX"))
    party = {r.author: r.party for r in budget.with_party(rows(spark, "author", ("Aná",), ("Bancada do PE",), ("Com. de Saúde",), ("Relator Geral",), ("Zé",)), [members]).collect()}
    assert party == {"Aná": "PX", "Bancada do PE": "Bancada", "Com. de Saúde": "Comissao", "Relator Geral": "Relatoria", "Zé": "Nao identificado"}
    assert budget.should_skip({"etag": "1"}, {"etag": "1"}) and not budget.should_skip({"etag": "1"}, {"etag": "2"}) and not budget.should_skip({}, {})
    now = spark.createDataFrame([("a", 10.0), ("b", 1.004), ("n", 3.0)], "k string, v double")
    old = spark.createDataFrame([("a", 4.0), ("b", 1.0), ("gone", 5.0)], "k string, v double")
    assert {(r.k, r.delta, round(r.share, 4)) for r in budget.growth(now, old, ["k"], "v").collect()} == {("a", 6.0, 0.6667), ("n", 3.0, 0.3333)}
    from civisight.operators.lookups import snapshot_diff
    assert "gone" not in {r.k for r in snapshot_diff(now, old, ["k"], "v").collect()}
    assert {r.k for r in snapshot_diff(now, old, ["k"], "v", include_vanished=True).collect()} == {"a", "n", "gone"}


def test_cards(spark):
    raw = rows(spark, "archive,ANO EXTRATO,MÊS EXTRATO,VALOR TRANSAÇÃO,TRANSAÇÃO,NOME ÓRGÃO SUPERIOR,NOME UNIDADE GESTORA",
               ("/x/202401_CPGF.zip", "2024", "1", "10,00", "Saque - dinheiro", "Presidência da República", "Agência Brasileira de Inteligência"),
               ("/x/202402_CPGF.zip", "2024", "13", "1.000,10", "COMPRA", "", "outra unidade s/a"))
    got = sorted(cards.landed_cards(raw).collect(), key=lambda r: r.month)
    assert [(r.month, r.amount, r.is_cash, r.body, r.unit) for r in got] == [
        (D(2024, 1, 1), Decimal("10.00"), True, "Presidência da República", "ABIN"), (D(2024, 2, 1), Decimal("1000.10"), False, cards.NO_BODY, "Outra Unidade S/A")]
    rates = cards.price_rates(rows(spark, "data,valor", ("01/01/2024", "9,9"), ("01/02/2024", "1,0"), ("01/04/2024", "2.0"), ("bad", "1")))
    months = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 4, 1),)], "month date")
    factors = {r.month.month: r.factor for r in cards.deflators(rates, months).collect()}
    assert factors == {1: 1.0302, 2: 1.02, 3: 1.02, 4: 1.0}


def test_sanctions(spark):
    raw = rows(spark, "TIPO DE PESSOA,CPF OU CNPJ DO SANCIONADO,NOME DO SANCIONADO,CATEGORIA DA SANÇÃO,ÓRGÃO SANCIONADOR,DATA INICIO SANÇÃO,DATA FINAL SANÇÃO,DATA PUBLICAÇÃO",
               ("J", "12.345", "Ana", "c", "o", "01/01/2020", "", "01/01/2020"), ("F", "***.12", "Bia", "c", "o", "01/01/2010", "31/12/2011", "01/01/2010"),
               ("F", "1", "Caio", "d", "o", "01/02/2030", "", "02/01/2024"))
    asof = D(2024, 1, 1)
    got = sanctions.landed_sanctions(raw, "CEIS", asof)
    assert {r.name: (r.document, r.active) for r in got.collect()} == {"Ana": ("12345", True), "Bia": ("***.12", False), "Caio": ("1", False)}
    assert {r.name for r in sanctions.retained(got, asof).collect()} == {"Ana", "Caio"}
    tables = {k: v.collect() for k, v in sanctions.summary(got, asof).items()}
    assert tables["totals"][0].active == 1 and tables["recent"][0].last_30_days == 0
    assert {r.name for r in sanctions.retained(got, asof).collect()} == {"Ana", "Caio"}


def test_registry(spark):
    raw = rows(spark, "MARCA,PROPRIETARIOS,NM_OPERADOR,CPF_CNPJ,SG_UF,NR_ANO_FABRICACAO,DT_CANC",
               ("PTABC", "Ana|1|50,5;Bia", "null", "12x", "SP", "1899", ""), ("", "null", "", "", "", "", ""), ("PTXYZ", "", "Voa", "34", "", "2001", "01012020"))
    got = registry.landed_registry(raw)
    assert {r.prefix_display: (r.document_masked, r.build_year, r.main_owner) for r in got.collect()} == {"PT-ABC": (True, None, "Ana"), "PT-XYZ": (False, 2001, None)}
    profile = registry.profile(got).first()
    assert (profile.rows, profile.active, profile.cancelled, profile.masked_documents, profile.without_state) == (2, 1, 1, 1, 1)
    hits = registry.find(got, ["pt-abc", "voa", "zzz"]).collect()
    assert [(r.query, r.prefix) for r in sorted(hits, key=lambda r: r.query)] == [("pt-abc", "PTABC"), ("voa", "PTXYZ")]
    assert {r.query: r.score for r in hits}["pt-abc"] == 500 + 48 + 110 + 6
    gate = registry.gate(got, got).first()
    assert (gate.accepted, gate.reason, gate.changed) == (False, "too few rows", False)


def test_monitors(spark):
    names = ("NR_PROTOCOLO_REGISTRO,SG_UF,NM_UE,DS_CARGO,DT_REGISTRO,DT_INICIO_PESQUISA,DT_FIM_PESQUISA,DT_DIVULGACAO,NM_EMPRESA,NM_EMPRESA_FANTASIA,NR_CNPJ_EMPRESA,"
             "QT_ENTREVISTADO,VR_PESQUISA,NM_ESTATISTICO_RESP,ST_PESQUISA_PROPRIA,DS_METODOLOGIA_PESQUISA,DS_PLANO_AMOSTRAL")
    base = ["Brasil", "Presidente", "01/02/2026", "", "#NULO#", "03/02/2026", "Empresa", "#NE#", "1", "2000", "1.000,00", "x", "S", "m", "p"]
    polls = monitors.landed_polls(rows(spark, names, ["BR067312026", "BR", *base], ["SP1", "SP", *base], ["BR000012026", "BR", *[*base[:5], "", *base[6:]]]))
    assert [(r.protocol, r.company, r.interviews, r.field_end, r.own_poll) for r in monitors.export_polls(polls).collect()] == [
        ("BR-06731/2026", "Empresa", 2000, None, True), ("BR-00001/2026", "Empresa", 2000, None, True)]
    seen = rows(spark, "id", ("BR067312026",))
    assert [r.id for r in monitors.poll_alerts(polls, seen, False).collect()] == ["BR000012026"]
    assert monitors.poll_alerts(polls, seen, True).count() == 0
    status = rows(spark, "id,status", ("BR067312026", "error"))
    assert monitors.questionnaire_targets(polls, status).count() == 1 and monitors.questionnaire_targets(polls, status, True).count() == 2
    replies = rows(spark, "url,reply", ("u1", 'Aqui: {"empresa":" Nome da Empresa ","uf":"spx","trabalhadores_resgatados":"7","resgate_status":"COM_RESGATE"}'), ("u2", "nada"))
    got = {r.url: r for r in monitors.extracted_reports(replies).collect()}
    assert (got["u1"].empresa, got["u1"].uf, got["u1"].trabalhadores_resgatados, got["u1"].resgate_status, got["u1"].error) == (None, "SP", 7, "com_resgate", None)
    assert (got["u2"].error, got["u2"].trabalhadores_resgatados) == ("unreadable", 0)
    jobs = rows(spark, "url,location", ("1", "London, UK"), ("2", "Remote"), ("3", "Remote (US only)"), ("4", "Lukewarm town"), ("5", "Remote, Brazil or UK"), ("6", "Paris"))
    assert {r.url for r in monitors.job_alerts(jobs, rows(spark, "url", ("2",)), False).collect()} == {"1", "5"}
    pages = rows(spark, "url,html", ("https://h/p", '<a href="/r/op-12.pdf">Op. 12 de 2019 SP</a><a href="/x">não</a><a href="/r/op-12.pdf">de novo</a>'))
    assert [(r.url, r.title, r.year, r.op_num, r.states) for r in monitors.report_list(pages).collect()] == [("https://h/r/op-12.pdf", "Op. 12 de 2019 SP", 2019, 12, ["SP"])]


BODY = "<p>Brasília, 12 de março de 2012</p>" + "<p>" + "Palavra do discurso. " * 12 + "</p>"


def test_corpus(spark):
    pages = rows(spark, "url,html", ("https://H/people/dilma-rousseff/discursos/1?x=1", f'<h1>Outro</h1><h1 class="documentFirstHeading">Fala &amp; voz</h1><div id="content-core">{BODY}</div>'),
                 ("https://h/people/jk/entrevistas/1958/2", "<title>Entrevista</title><p>curto</p>"))
    parsed = corpus.document_pages(pages, 2030)
    got = {r.url: r for r in parsed.collect()}
    first = got["https://h/people/dilma-rousseff/discursos/1"]
    assert (first.title, first.date, first.date_source, first.location) == ("Fala & voz", D(2012, 3, 12), "text", "Brasília")
    assert got["https://h/people/jk/entrevistas/1958/2"].date_source == "url-year"
    listing = rows(spark, "url,title", *[(u, "") for u in got])
    records = {r.url: r for r in corpus.records(
        listing, rows(spark, "url,person", (list(got)[0], "x")).limit(0), parsed, {"jk": "Juscelino"}, "planalto", "p", {"entrevist": "entrevista"}, "discurso", "biblioteca", "people").collect()}
    assert records["https://h/people/dilma-rousseff/discursos/1"].term == "Dilma 1 (2011-2014)"
    jk = records["https://h/people/jk/entrevistas/1958/2"]
    assert (jk.term, jk.type, jk.person, jk.slug) == ("Juscelino (1956-1961)", "entrevista", "Juscelino", "jk")
    found = rows(spark, "url", ("a",), ("b",), ("c",), ("d/view",))
    known = spark.createDataFrame([("a", "t", "x", 0), ("b", "t", "", 1), ("c", "t", "", 3)], "url string, title string, text string, failures int")
    assert [r.url for r in corpus.pending_details(known, found, 3).collect()] == ["d/view", "b"]


PERSON = classify.PersonRules(names=["Ana Prado"], context=["jornalista"], profile_domains=["orcid.org"], dropped_domains=["own.example"])


def test_clippings(spark):
    page = ('<html><head><title>Título | Site</title><meta property="og:title" content="Og"><meta property="og:site_name" content="Site"><link rel="canonical" href="https://www.n.com/a/?utm_x=1">'
            '<meta name="author" content="Ana Prado"><meta property="article:published_time" content="2024-01-02T03:04:05+00:00"></head><body><h1>Grande furo - Site</h1><p>Texto de Ana Prado &amp; equipe</p></body></html>')
    got = clippings.page_metadata(rows(spark, "url,html", ("https://n.com/a", page), ("https://n.com/b", "<title>UK</title>")), ["Ana Prado"]).collect()
    meta = {r.url: r for r in got}["https://n.com/a"]
    assert (meta.title, meta.site_name, meta.canonical_url, meta.author_names, str(meta.published_at)) == ("Grande furo", "Site", "https://n.com/a", ["Ana Prado"], "2024-01-02 03:04:05")
    assert "Ana Prado & equipe" in meta.text_excerpt
    assert {r.url: r.title for r in got}["https://n.com/b"] == "UK"

    seeds = spark.createDataFrame([
        ("https://www.n.com/a/?utm_s=1", "UK", "curta", "", "s1", "", 1), ("https://n.com/a", "Grande furo", "d" * 50, "", "s2", '"Ana Prado"', 2), ("https://n.com/a", "Outro", "", "authored", "s1", "q", 3)],
        "url string, title string, description string, category_hint string, source_label string, query string, row_no int").withColumns({c: F.lit("") for c in ("relation_hint", "notes", "published_at")})
    merged = clippings.candidates(seeds).first()
    assert (merged.url, merged.title, merged.description, merged.category_hint, merged.source_labels, merged.queries) == (
        "https://n.com/a", "Grande furo", "d" * 50, "authored", ["s1", "s2"], ['"Ana Prado"', "q"])

    def item(url, title, text="", authors=(), hint="", query="x"):
        return (url, title, "", text, list(authors), "", "", [query], "", hint, ["seed"])
    items = spark.createDataFrame([
        item("https://n.com/1", "Grande furo", "por Ana Prado"), item("https://m.com/2", "Grande Furo!", "texto com ana prado e jornalista"), item("https://m.com/3", "Grande furo", "texto com ana prado e jornalista"),
        item("https://m.com/4", "Nota", "segundo Ana Prado, algo"), item("https://m.com/5", "Podcast da semana", "ana prado"), item("https://orcid.org/6", "Página", "ana prado"),
        item("https://m.com/7", "Nota", "nada", hint="authored"), item("https://own.example/8", "Eu", "ana prado"), item("https://linkedin.com/9", "Perfil", "ana prado"),
        item("https://m.com/tag/10", "Tag", "ana prado jornalista"), item("https://m.com/11", "Nota", "ana prado", query='"Ana Prado"'), item("https://m.com/12", "Nota", "apos reportagem, jornalista"),
    ], "url string, title string, description string, text_excerpt string, author_names array<string>, notes string, site_name string, queries array<string>, relation_hint string, category_hint string, source_labels array<string>")
    got = {int(r.url.rsplit("/", 1)[1]): (r.category, r.relation) for r in clippings.classified(items, PERSON).collect()}
    assert got == {
        1: ("authored", "author"), 2: ("mention", "mentioned"), 3: ("republication", "republication / syndication"), 4: ("quoted", "quoted as source"),
        5: ("interview", "interviewee"), 6: ("profile", "profile"), 11: ("mention", "mentioned"), 12: ("echo", "follow-up of own work")}


def test_listed_labels_survive_the_cut(spark):
    from civisight.operators import profiles

    df = rows(spark, "c", *[(x,) for x in "aaabbccd"])
    got = {(r.label, r.n) for r in profiles.corpus_profile(df, ["c"], 2, {"c": ["d", "zz"]}).collect()}
    assert got == {("a", 3), ("b", 2), ("d", 1), ("zz", 0)}


def test_snippets_take_a_document_apart_once(spark):
    from civisight.functions.text import snippet

    docs = spark.createDataFrame([(1, "u", "t", None, "Opening.\nSpoke with Ana Prado; Rui Lemos came.\nRui Lemos left! \ufeff\n\nEnd"), (2, "v", "t", None, "Nobody")],
                                 "doc_id int, url string, title string, date date, text string")
    people = spark.createDataFrame([(7, "x", "Ana Prado"), (8, "x", "Rui Lemos")], "id int, kind string, name string")
    aliases = people.selectExpr("id as entity_id", "name as alias", "lower(name) as alias_key", "1 as alias_rank", "2 as n_tokens")
    got = corpus.mention_rows(docs, aliases, people)
    want = docs.select(snippet("text", F.array(F.lit("Rui Lemos")))).first()[0]
    assert sorted((r.entity_id, r.occurrences, r.snippet) for r in got.collect()) == [(7, 1, want), (8, 2, want)] and want == "Spoke with Ana Prado; Rui Lemos came."
    top = got._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert "split(" not in top  # not once more per person


def test_text_records_read_documents_once(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["text_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan  # the landed texts, and of them the columns that are asked for


def test_has_text_is_what_clean_text_leaves(spark):
    from civisight.functions.text import clean_text, has_text

    rows = spark.createDataFrame([(x,) for x in (None, "", " ", "\ufeff \t", "\u00a0\u2003\n", "\u200b", "a", " \n\ufeffb ", "\x00", "\x0b\x85")], "t string")
    assert rows.filter(~clean_text("t").isNotNull().eqNullSafe(F.coalesce(has_text("t"), F.lit(False)))).count() == 0
