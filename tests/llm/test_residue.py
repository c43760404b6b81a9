"""Detectors on what they must and must not flag."""

import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import residue  # noqa: E402

SCHEMA = "doc_id bigint, source string, text string"
BAD = {
    "placeholder": ["Dear {{ first_name }}, your order {{order.id}} has shipped.", "Hello ${user}, welcome to ${site.name}!", "Write to [Your Company Name] at [insert address here].", "Total: %(amount)s for %(name)s", "Value: [object Object], [object Object]"],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "# Services\n\nCOMING SOON"],
    "error_page": ["404 Not Found\n\nnginx", "503 Service Temporarily Unavailable", "The page you are looking for could not be found.", "Access Denied: you have no permission."],
    "script_notice": ["Please enable JavaScript to view the comments.", "JavaScript is disabled in your browser.", "Checking your browser before accessing example.test"],
}
GOOD = [
    "The sensor reported 404 batches and 503 rows; the page of the ledger was not found wanting.", "```js\nconst x = `${a}`; // {{ b }}\n```\nThis code shows how a template is filled by the renderer.",
    "A long report on HTTP. " + " ".join(f"term{i}" for i in range(80)) + " A 404 not found answer means that the resource is missing.", "", "   ", ".", None,
    "Ein Text über Platzhalter wie {{name}} in Vorlagen: " + " ".join(f"wort{i}" for i in range(200)),
]


def flags(spark, rows, **options):
    got = residue.residue(spark.createDataFrame(rows, SCHEMA), residue.Residue(**options))
    return {r.doc_id: (r.residue, r.reasons) for r in got.collect()}


def test_detectors(spark):
    rows = [(i, "s", t) for i, t in enumerate(t for v in BAD.values() for t in v)]
    want = {i: k for i, k in enumerate(k for k, v in BAD.items() for _ in v)}
    got = flags(spark, rows)
    assert all(got[i][0] and want[i] in got[i][1].split(",") for i in want), {i: got[i] for i in want if want[i] not in got[i][1]}


def test_real_content_is_left(spark):
    got = flags(spark, [(i, "s", t) for i, t in enumerate(GOOD)])
    assert len(got) == len(GOOD) and not any(f for f, _ in got.values())


def test_canned_answers_need_the_hosts_evidence(spark):
    say = lambda n, slug: f"https://shop.test/{slug}-{n}\nSorry, nothing here for number {n}"
    rows = [(i, "s", say(i, f"blue-kettle-{i}")) for i in range(5)]
    rows += [(10 + i, f"s{i}", "just a short remark") for i in range(2)]
    rows += [(20 + i, "s", f"https://shop.test/nothing-here-{i}\nSorry, nothing here for number {i}") for i in range(3)]
    got = flags(spark, rows)
    assert {i for i, (f, _) in got.items() if f} == {0, 1, 2, 3, 4} and got[0][1] == "canned"


def test_repeated_rows_nulls_and_empty_tables(spark):
    from pyspark.sql import functions as F

    t = "short words"
    got = flags(spark, [(1, None, t), (1, None, t), (2, None, t), (3, "x", t), (None, None, None)])
    assert len(got) == 4 and not any(f for f, _ in got.values())
    # without an address or a title, repetition alone is no evidence
    assert not any(f for f, _ in flags(spark, [(i, None, "some short words") for i in range(5)] + [(10 + i, "s", "中") for i in range(9)]).values())
    assert flags(spark, [(i, None, f"Report {i}\nsome short words") for i in range(3)])[0] == (True, "canned")
    assert flags(spark, []) == {}
    clash = spark.createDataFrame([(1, "s", "404 Not Found")], SCHEMA).withColumns({"host": F.lit(1), "terms": F.lit("x"), "p": F.lit(0), "copies": F.lit(None)})
    assert [(r.doc_id, r.reasons) for r in residue.residue(clash).collect()] == [(1, "error_page")]


def test_title_is_compared_with_the_body(spark):
    canned = [(i, "s", "Harvest report\nTemporarily offline, try later") for i in range(4)]
    echo = [(10 + i, "s", f"# Blue kettle {i}\nhttps://shop.test/blue-kettle-{i}\nNothing to see, sorry") for i in range(4)]
    real = [(20 + i, "s", f"Harvest report {i}\nThis harvest was good") for i in range(4)]
    got = flags(spark, canned + echo + real)
    assert {i for i, (f, _) in got.items() if f} == {0, 1, 2, 3, 10, 11, 12, 13}


def test_copies_are_different_addresses(spark):
    one = [(i, "s", "https://shop.test/blue-kettle\nSorry, nothing here") for i in range(5)]
    two = [(10 + i, "s", f"https://other.test/blue-kettle-{i}\nSorry, nothing here") for i in range(3)]
    got = residue.residue(spark.createDataFrame(one + two, SCHEMA)).collect()
    assert {r.doc_id: (r.residue, r.copies) for r in got} == {i: (False, 1) for i in range(5)} | {10 + i: (True, 3) for i in range(3)}


PLANTED = {
    "error_page": [
        "404 Not Found", "403 Forbidden\nnginx/1.18.0", "502 Bad Gateway\n\ncloudflare", "500 Internal Server Error. The server encountered an internal error, please try again later.", "Sorry, the page you are looking for could not be found. Go back to the home page.",
        "Oops! Something went wrong. Please reload.", "An unexpected error has occurred. Reference: 18.2f3a", "Your session has expired. Please log in again.", "Access Denied\nYou don't have permission to access this on this server.", "Seite nicht gefunden\nDie gesuchte Seite existiert leider nicht.",
        "Fehler 404: Die Seite wurde nicht gefunden. Zurück zur Startseite", "Zugriff verweigert", "Ein Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.", "Page introuvable\nLa page demandée n'existe pas.", "Erreur 404 - page non trouvée. Retour à la page d'accueil", "Accès refusé", "Une erreur est survenue, veuillez réessayer plus tard.",
        "Página no encontrada", "Lo sentimos, la página no existe. Volver a la página de inicio", "Acceso denegado. Error 403", "Se ha producido un error. Inténtelo de nuevo más tarde.", "Página não encontrada", "Ocorreu um erro. Tente novamente mais tarde.", "Pagina non trovata - errore 404", "Accesso negato", "Pagina niet gevonden", "Nie znaleziono strony", "Wystąpił błąd. Spróbuj ponownie później.",
        "Sayfa bulunamadı", "Страница не найдена. Вернуться на главную", "Произошла ошибка. Попробуйте позже.", "页面不存在", "抱歉，找不到页面。返回首页", "访问被拒绝", "ページが見つかりません", "申し訳ございません。お探しのページが見つかりません。", "페이지를 찾을 수 없습니다", "الصفحة غير موجودة", "503 Service Temporarily Unavailable", "Too Many Requests", "<html><head><title>404 Not Found</title></head><body><h1>Not Found</h1></body></html>",
    ],
    "script_notice": [
        "Please enable JavaScript to view this page.", "You need to enable JavaScript to run this app.", "JavaScript is disabled in your browser. Please enable it to continue.", "This site requires JavaScript.", "Please turn on cookies and reload.", "Checking your browser before accessing example.test", "Please verify you are human", "Veuillez activer JavaScript", "Veuillez activer les cookies pour continuer.",
        "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "JavaScript ist deaktiviert", "Por favor, active JavaScript", "Habilite JavaScript en su navegador", "Ative o JavaScript para continuar", "Attiva JavaScript nel browser", "Schakel JavaScript in", "Włącz JavaScript, aby kontynuować", "Включите JavaScript в браузере", "JavaScript'i etkinleştirin", "请启用JavaScript", "请在浏览器中启用 JavaScript", "JavaScriptを有効にしてください", "JavaScript를 활성화하세요",
    ],
    "placeholder": ["Dear {first_name}, thanks for your order #ORDER_ID#.", "Hola {{nombre}}, bienvenido", "Bonjour [votre nom], merci", "Sehr geehrte {% anrede %}", "Hi %FIRST_NAME%, your code is %CODE%", "Contact: <%= user.email %>", "Total: $AMOUNT$", "Hello *|FNAME|*", "Ship to __ADDRESS__", "<INSERT_TITLE_HERE>", "[[contact.name]] wrote", "Your ${product} is ready", "#{user.name} 様", "你好 {姓名}", "Kind regards, [Your Name]"],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "Duis aute irure dolor in reprehenderit. Lorem ipsum dolor sit amet.", "Coming soon!", "Demnächst verfügbar", "Bientôt disponible", "Próximamente", "The quick brown fox jumps over the lazy dog.", "test test test test test test test test test", "Under construction", "敬请期待", "Your text here"],
}
CONTENT = [
    "At 14:02 the load balancer returned 502 Bad Gateway for ten minutes; Anna restarted two pods and wrote a note for the night shift.", "A pangram such as the quick brown fox jumps over the lazy dog shows every letter of a typeface in use since 1885.", "Type designers set lorem ipsum dolor sit amet because readers look at shapes, not words, when a page makes no sense.",
    "The archive was not found wanting when auditors came in May; all forty ledgers were on the shelf.", "JavaScript grew out of ten days of work in 1995 and is now standardised by a committee.", "We shipped cookies to forty schools in March and asked each head teacher for a receipt.", "The valve at Gaklun shows 403 litres, the pump at Bamus 404, and both were read twice.",
    "{\"a\": 1, \"b\": [2, 3]}", "if (x[i] > y[j]) { total += x[i]; }", "\\frac{a}{b} and \\sum_{i=1}^{n} x_i", "{é\n, 'x': null}", "Die Mitarbeiter fanden den Ordner nicht gefunden zu haben peinlich, also suchten sie am Montag im ganzen Archiv noch einmal danach.", "I can't reach the valve since noon and nobody answers the radio on channel 5.", "价格上涨了百分之五，市场反应平静。", "節点の版を確認した487、出典は回答に信頼を記録した。",
    "<s></s><unk>", "<|endoftext|>", "中", "a", "snapshot", "The committee denied access to the quarry for two weeks, so the survey was moved to June and the budget cut.", "Support for the old parser ends in June; please move your scripts and tell us what breaks.", "Le service des eaux a indiqué que la pression était revenue à la normale vers midi dans tous les quartiers.", "Error-rate on Preagran rose from 59 to 850, says Jaiklurflis.",
]


def test_planted_cases_among_real_texts(spark, data):
    """Precision and recall of residue planted beside all documents of the tables, which hold none, and beside content that mentions it."""
    real = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "text").collect()]
    bad = [(10**6 + i, f"s{i}", t) for i, t in enumerate(t for v in PLANTED.values() for t in v)]
    good = [(2 * 10**6 + i, f"s{i}", t) for i, t in enumerate(CONTENT)]
    canned = [(3 * 10**6 + i, "s", f"https://shop{i % 4}.test/{w}-{i}\nNothing to show for number {i} today") for i in range(40) for w in [["kettle", "lamp", "chair"][i % 3]]]
    got = {r.doc_id: r for r in residue.residue(spark.createDataFrame(real + bad + good + canned, SCHEMA)).collect()}
    flagged, planted = {i for i, r in got.items() if r.residue}, {i for i, *_ in bad + canned}
    named = dict(zip((i for i, *_ in bad), (k for k, v in PLANTED.items() for _ in v)))
    missed, wrong = [t for i, _, t in bad if i not in flagged], [(t, got[i].reasons) for i, _, t in real + good if i in flagged]
    misnamed = [(t, got[i].reasons) for i, _, t in bad if i in flagged and named[i] not in got[i].reasons]
    recall, precision = len(flagged & planted) / len(planted), len(flagged & planted) / len(flagged)
    assert recall >= 0.95 and precision >= 0.95 and len(misnamed) <= 2, (recall, precision, missed, wrong, misnamed)


def test_clean_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "s", "404 Not Found"), (2, "s", "A valve was read at noon by Anna."), (None, "s", None), (3, None, "")], SCHEMA)
    assert sorted((r.doc_id or 0) for r in residue.clean(docs).collect()) == [0, 2, 3]
    at = docs.withColumnRenamed("source", "link").selectExpr("doc_id", "text", "'s' as source", "concat('https://h.test/p', doc_id) as link")
    assert residue.residue(at, address="link").where("residue").count() == 1


def test_sql_finds_the_same(spark, tmp_path):
    import duckdb

    rows = [(i, f"s{i % 3}", t) for i, t in enumerate([t for v in PLANTED.values() for t in v] + CONTENT + GOOD)] + [(10**6 + i, "s", f"https://shop{i % 4}.test/kettle-{i}\nNothing to show for number {i} today") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = sorted(con.execute(residue.sql()).fetchall())
    assert sorted((r.doc_id, r.residue, r.reasons, r.copies) for r in residue.residue(df).collect()) == want
