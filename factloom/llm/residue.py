"""Template residue and error-page text (problem 8).

Each text is read for an address (a column, or the first URL in it), a title (first heading or short first line) and body terms.

- placeholder: unfilled delimiters of any syntax around a name, outside code, that make up a fair part of the text.
- filler: pseudo-Latin or pangram words that make up much of a text, one or two words over and over, or a short "coming soon".
- error_page, script_notice: phrases of error pages and of notices that want scripts, cookies or a human, in several languages. A
  mention is no error page: these phrases, and those that go with them ("please try again later"), must cover much
  of a short text, or its title; a smaller part will do if its host repeats the text under other addresses.
- canned: a text of few terms whose skeleton (digits, address and title aside) one host gives at several addresses, or under
  titles, with which the body shares no term.

All of it is column expressions; phrases are looked for in short texts only. Shuffled are a hash, a host and flags.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut

# Delimiters of templates around a name, as regular expressions that Java and RE2 read alike.
_NAME = r"[\p{L}_][\p{L}\p{M}\p{Nd}_.:| -]{0,40}"
PLACEHOLDER = "|".join([
    r"\{\{[^{}\n]{1,60}\}\}", r"\{%[^{}\n]{1,60}%\}", rf"[$#]\{{{_NAME}\}}", rf"(?:^|[^\p{{L}}\p{{Nd}}\\{{}}^_$#%])\{{[\p{{L}}_]{_NAME[8:]}\}}", r"<%[^<>\n]{1,60}%>", rf"\[\[{_NAME}\]\]", r"%\([\p{L}_]\w{0,40}\)[a-z]",
    r"#[A-Z][A-Z0-9_]{2,40}#", r"%[A-Z][A-Z0-9_]{2,40}%", r"\$[A-Z][A-Z0-9_]{2,40}\$", r"@@[A-Z][A-Z0-9_]{1,40}@@", r"__[A-Z][A-Z0-9_]{1,40}__", r"\*\|[A-Z][A-Z0-9_:]{1,40}\|\*", r"<[A-Z]+_[A-Z0-9_]{1,40}>",
    r"\[(?i:insert|your|enter|add|name|date|ihr|ihre|hier|votre|insérer|su|tu|insertar|inserir|seu|sua|inserisci|uw|twój|вставьте|ваш|ваше)(?: [^\[\]\n]{1,40})?\]", r"<(?i:insert|your|enter)[ _-][^<>\n]{1,40}>", r"\[object Object\]",
])

#: How each of them begins.
MARK = r"[{<\[%#$@_*](?:[{%(@_|\[]|[\p{L}])"

# Words of filler texts.
LATIN = (
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo "
    "consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
PANGRAM = "the quick brown fox jumps jumped over lazy dog dogs".split()
FILLER = [
    "coming soon", "under construction", "your text here", "text goes here", "sample text", "placeholder text", "dummy text", "untitled document", "insert text here", "replace this text", "hello world",
    "demnächst verfügbar", "im aufbau", "hier steht ihr text", "beispieltext", "platzhaltertext", "bientôt disponible", "en construction", "texte à venir", "votre texte ici", "próximamente", "en construcción", "texto de ejemplo", "su texto aquí",
    "em breve", "em construção", "seu texto aqui", "prossimamente", "in costruzione", "testo di esempio", "binnenkort beschikbaar", "in aanbouw", "wkrótce", "w budowie", "yakında", "yapım aşamasında", "скоро открытие", "в разработке", "敬请期待", "建设中", "近日公開", "準備中", "준비 중입니다",
]

# Phrases of error pages.
ERROR = [
    "page not found", "page cannot be found", "page can't be found", "page could not be found", "page couldn't be found", "page was not found", "page does not exist", "page doesn't exist", "page you are looking for", "page you requested", "file not found", "not found",
    "could not be found", "bad request", "unauthorized", "unauthorised", "forbidden", "access denied", "access is denied", "access to this page has been denied", "internal server error", "bad gateway", "service unavailable", "service temporarily unavailable", "temporarily unavailable",
    "gateway timeout", "gateway time out", "too many requests", "too many redirects", "something went wrong", "an error occurred", "an error has occurred", "an unexpected error occurred", "an unexpected error has occurred", "session expired", "session has expired", "session timed out",
    "this site can't be reached", "down for maintenance", "under maintenance", "no such page", "no such file or directory", "content is not available", "content not available",
    "seite nicht gefunden", "seite wurde nicht gefunden", "seite konnte nicht gefunden werden", "seite existiert nicht", "nicht gefunden", "zugriff verweigert", "interner serverfehler", "ein fehler ist aufgetreten", "dienst nicht verfügbar", "sitzung abgelaufen", "sitzung ist abgelaufen", "wartungsarbeiten",
    "page introuvable", "page non trouvée", "page n'existe pas", "page demandée", "accès refusé", "accès interdit", "erreur interne du serveur", "une erreur est survenue", "une erreur s'est produite", "service indisponible", "session expirée", "session a expiré",
    "página no encontrada", "no se encontró la página", "no se ha encontrado la página", "página no existe", "acceso denegado", "error interno del servidor", "se ha producido un error", "ha ocurrido un error", "servicio no disponible", "sesión caducada", "sesión ha caducado", "sesión ha expirado",
    "página não encontrada", "página não existe", "acesso negado", "erro interno do servidor", "ocorreu um erro", "serviço indisponível", "sessão expirada", "sessão expirou",
    "pagina non trovata", "pagina non esiste", "accesso negato", "errore interno del server", "si è verificato un errore", "servizio non disponibile", "sessione scaduta",
    "pagina niet gevonden", "pagina bestaat niet", "toegang geweigerd", "interne serverfout", "er is een fout opgetreden", "sidan hittades inte", "sidan kunde inte hittas", "åtkomst nekad", "ett fel har uppstått", "siden blev ikke fundet",
    "nie znaleziono strony", "strona nie istnieje", "strona nie została znaleziona", "odmowa dostępu", "dostęp zabroniony", "wewnętrzny błąd serwera", "wystąpił błąd", "stránka nenalezena", "az oldal nem található",
    "sayfa bulunamadı", "erişim engellendi", "erişim reddedildi", "bir hata oluştu", "sunucu hatası", "không tìm thấy trang", "đã xảy ra lỗi", "halaman tidak ditemukan",
    "страница не найдена", "страница не существует", "доступ запрещён", "доступ запрещен", "внутренняя ошибка сервера", "произошла ошибка", "сервис недоступен", "сторінку не знайдено", "η σελίδα δεν βρέθηκε",
    "页面不存在", "找不到页面", "找不到頁面", "页面未找到", "未找到页面", "頁面不存在", "访问被拒绝", "拒绝访问", "服务器错误", "服务器内部错误", "发生错误", "ページが見つかりません", "ページは存在しません", "お探しのページ", "アクセスが拒否", "エラーが発生しました", "サーバーエラー",
    "페이지를 찾을 수 없습니다", "접근이 거부되었습니다", "오류가 발생했습니다", "서버 오류", "الصفحة غير موجودة", "تم رفض الوصول", "حدث خطأ", "הדף לא נמצא", "הגישה נדחתה", "पृष्ठ नहीं मिला", "ไม่พบหน้า",
]
# Checks for humans, in place of content.
HUMAN = [
    "checking your browser", "verify you are human", "verify that you are human", "verify you are a human", "verify that you are a human", "are you a robot", "you are not a robot", "unusual traffic", "complete the captcha", "solve the captcha", "vérifiez que vous êtes humain", "kein roboter", "no eres un robot", "no soy un robot", "não é um robô", "вы не робот", "请完成验证", "人机验证",
]
# What goes with such phrases.
SUPPORT = [
    "please", "sorry", "we're sorry", "we are sorry", "oops", "error", "http", "status", "code", "try again", "try again later", "later", "check the url", "check the address", "url", "address", "go back", "go to", "home page", "homepage", "home", "back to", "return to", "contact", "support", "administrator", "webmaster", "reload", "refresh", "server", "request", "request id",
    "reference", "nginx", "apache", "cloudflare", "ray id", "you have no permission", "you do not have permission", "you don't have permission", "to access", "on this server", "before accessing", "to view", "to continue", "to run this app", "browser", "in your browser", "this site", "this page", "this website", "settings",
    "bitte", "fehler", "leider", "ihrem browser", "versuchen sie es", "später", "erneut", "zur startseite", "startseite", "zurück", "um fortzufahren", "veuillez", "désolé", "erreur", "votre navigateur", "réessayer", "plus tard", "page d'accueil", "retour à", "pour continuer",
    "por favor", "lo sentimos", "inténtelo", "de nuevo", "más tarde", "volver", "página de inicio", "su navegador", "desculpe", "erro", "tente novamente", "mais tarde", "voltar", "seu navegador", "spiacenti", "errore", "riprova", "più tardi", "torna alla", "nel browser", "przepraszamy", "błąd", "spróbuj ponownie", "później", "strony głównej",
    "пожалуйста", "извините", "ошибка", "попробуйте", "позже", "вернуться", "на главную", "в браузере", "请", "抱歉", "稍后", "重试", "返回首页", "浏览器", "申し訳", "しばらく", "もう一度", "お試しください", "ブラウザ", "죄송합니다", "다시 시도", "브라우저에서",
]
# What a page asks for, how it asks, and what it says of it.
_SUBJECT = ["javascript", "java script", "cookies"]
_WANT = [
    "enable", "activate", "turn on", "switch on", "allow", "accept", "requires", "require", "needs", "need", "without", "support", "aktivieren sie", "aktivieren", "einschalten", "benötigt", "erfordert", "erlauben", "activer", "activez", "autoriser", "nécessite", "requiert", "activar", "active", "activa", "habilite", "habilitar", "necesita", "requiere",
    "ative", "ativar", "habilite o", "requer", "attiva", "attivare", "abilita", "abilitare", "richiede", "schakel", "vereist", "włącz", "włączyć", "wymaga", "включите", "включить", "требует", "увімкніть", "aktivera", "kräver", "povolte", "engedélyezze", "bật", "aktifkan",
]
_STATE = [
    "is required", "is disabled", "is not enabled", "is turned off", "is off", "must be enabled", "needs to be enabled", "to be enabled", "enabled", "not enabled", "not supported", "seems to be disabled", "appears to be disabled", "required", "disabled",
    "ist deaktiviert", "deaktiviert", "aktivieren", "einschalten", "erforderlich", "est désactivé", "désactivé", "requis", "est nécessaire", "está desactivado", "desactivado", "deshabilitado", "desativado", "é necessário", "è disabilitato", "disabilitato", "richiesto", "inschakelen", "is vereist", "jest wyłączony", "wyłączony", "etkinleştirin", "etkin değil", "gerekiyor", "отключен", "необходим", "выключен",
]
_CJK_ASK, _CJK_STATE = ["启用", "啟用", "开启", "打开", "允许", "支持", "需要"], ["启用", "啟用", "禁用", "有効", "無効", "必要", "オン", "활성화", "필요", "켜"]


def _plain(phrase: str) -> str:
    """A phrase as in _words: each word between blanks of its own; scripts without blanks stay open on both ends."""
    words = "".join(c if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd" else " " for c in phrase.lower()).split()
    open_ = len(words) == 1 and any("぀" <= c <= "鿿" or "฀" <= c <= "๿" for c in phrase)
    return words[0] if open_ else f" {'  '.join(words)} "


def _any(phrases: list[str]) -> str:
    return "|".join(sorted(dict.fromkeys(_plain(x) for x in phrases), key=lambda x: (-len(x), x)))


_SUBJECTS = _any(_SUBJECT)
SCRIPT = (
    rf"(?:{_any(_WANT)})(?: [^ ]+ ){{0,2}}(?:{_SUBJECTS})(?: [^ ]+ ){{0,1}}(?:{_any(_STATE)})?|(?:{_SUBJECTS})(?: [^ ]+ ){{0,3}}(?:{_any(_STATE)})|"
    rf"(?:{'|'.join(_CJK_ASK)})[^ ]{{0,6}} {{0,2}}(?:javascript|cookie)|(?:javascript|cookie)s?[^ ]{{0,8}} {{0,2}}[^ ]{{0,8}}(?:{'|'.join(_CJK_STATE)})|{_any(HUMAN)}"
)
ERRORS, SUPPORTS, FILLERS = _any(ERROR), _any([*SUPPORT, *map(str, [400, 401, 403, 404, 405, 408, 410, 429, 500, 501, 502, 503, 504])]), _any(FILLER)
LATINS, PANGRAMS = _any(LATIN), _any(PANGRAM)
FENCED = r"(?s:```.*?(?:```|$))|`[^`\n]{1,80}`"
URL = r"https?://[\p{L}\p{Nd}_.-]+(?:/[^\s?#<>\"']*)?"
_GAP = r"[ \t\r\n]"
HEADING = r"(?:^|\n) {0,3}#{1,3} +([^\n]+)"
TAGGED = r"<(?:title|h1|TITLE|H1)[^<>]{0,80}>([^<\n]+)<"
FIRST = rf"^{_GAP}*([^ \t\r\n][^\n]{{0,79}})\n{_GAP}*[^ \t\r\n]"
NOT_WORD = r"[^\p{L}\p{M}\p{Nd}]+"


@dataclass(frozen=True)
class Residue:
    """page: most characters of a text that a single notice can fill. few: most distinct terms of a text of little information, least:
    fewest. copies: least addresses (or titled texts) of one skeleton on one host. share: least part of the text that placeholders
    make up. filled: least part that filler makes up. covered: least part that phrases make up; repeated: where the host repeats it."""

    page: int = 600
    few: int = 12
    least: int = 3
    copies: int = 3
    share: float = 0.02
    filled: float = 0.5
    covered: float = 0.35
    repeated: float = 0.2


def _anchors(phrases: list[str]) -> Column:
    """The longest word of each phrase: a text without any of them holds none of the phrases."""
    return F.array(*map(F.lit, sorted({max(_plain(x).split(), key=len) for x in phrases if _plain(x).startswith(" ")})))


#: Scripts without blanks, in which phrases are looked for wherever they stand.
OPEN = "[\u0e00-\u0e7f\u3040-\u9fff]"


def _words(x: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), NOT_WORD, "  ")), F.lit(" "))


def _terms(x: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(x), NOT_WORD, " ")), " ")), lambda t: F.length(t) > 0)


def _long(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x))


def _all(x: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(f"(?:{pattern})"), F.lit(0))


def features(documents: DataFrame, p: Residue = Residue(), address: str | None = None) -> DataFrame:
    """Narrow row of each text: doc_id, host, skeleton, place, flags of the detectors, apart (title and slug share no term with the body)."""
    text = F.coalesce("text", F.lit(""))
    url = F.coalesce(F.col(address), F.lit("")) if address else F.when(F.instr(text, "://") > 0, F.regexp_extract(text, URL, 0)).otherwise("")
    prose = F.when(F.instr(text, "`") > 0, F.regexp_replace(text, FENCED, " ")).otherwise(text)
    d = documents.select("doc_id", "source", url.alias("url"), prose.alias("prose"), F.length(text).alias("n"))
    short = F.col("n").between(1, p.page)
    marks = F.when(F.col("prose").rlike(MARK), _all("prose", PLACEHOLDER))
    d = d.withColumns({
        "marks": marks, "latin": F.when(F.lower("prose").rlike("ipsum|consectetu|eiusmod|incididunt"), _all(_words(F.col("prose")), LATINS)),
        "bare": F.when(short, F.regexp_replace("prose", r"https?://[^ \t\r\n]+", " ")),
    })
    d = d.withColumn("title", F.when(short, F.coalesce(*[F.nullif(F.trim(F.regexp_extract("bare", x, 1)), F.lit("")) for x in (HEADING, TAGGED, FIRST)], F.lit(""))))
    at = F.when(F.col("title") != "", F.instr("bare", F.col("title"))).otherwise(0)
    rest = F.when(at > 0, F.concat(F.substring("bare", F.lit(1), at - 1), F.lit(" "), F.substring("bare", at + F.length("title"), F.length("bare")))).otherwise(F.col("bare"))
    path = F.regexp_extract("url", r"https?://[^/]+(/.*)", 1)
    d = d.withColumns({"w": F.when(short, _words(F.col("bare"))), "tw": F.when(short & (F.col("title") != ""), _words(F.col("title"))), "rest": F.when(at > 0, rest)})
    split = lambda c: F.filter(F.array_distinct(F.split(F.trim(F.col(c)), "  ")), lambda t: F.length(t) > 0)
    d = d.withColumns({"all": split("w"), "title_terms": F.when(short, F.coalesce(split("tw"), F.array().cast("array<string>")))})
    slug = F.filter(_terms(path), lambda t: ~t.rlike(r"^\p{Nd}+$"))
    d = d.withColumns({"body": F.coalesce(_terms(F.col("rest")), F.col("all")), "slug": F.when(short, F.when(F.col("url") != "", slug).otherwise(F.array().cast("array<string>")))})
    part = lambda pattern, x="w": _long(F.transform(_all(x, pattern), lambda m: F.replace(m, F.lit(" "), F.lit("")))) / F.greatest(F.length(F.replace(F.col(x), F.lit(" "), F.lit(""))), F.lit(1))
    open_ = F.col("w").rlike(OPEN)
    # cheap tests first: most texts hold none of the words
    may = {ERRORS: F.arrays_overlap("all", _anchors(ERROR)) | open_, FILLERS: F.arrays_overlap("all", _anchors(FILLER)) | open_, SCRIPT: F.arrays_overlap("all", _anchors(HUMAN)) | (F.instr("w", "javascript") > 0) | (F.instr("w", "java  script") > 0) | (F.instr("w", "cookie") > 0) | open_}
    holds = lambda pattern: short & may[pattern] & F.col("w").rlike(pattern)
    phrase = lambda pattern: F.when(holds(pattern), F.greatest(part(f"{pattern}|{SUPPORTS}"), F.when(F.col("tw").rlike(pattern), part(f"{pattern}|{SUPPORTS}", "tw")).otherwise(0))).otherwise(0.0)
    size = F.size("all")
    little = short & size.between(p.least, p.few)
    letters_of = F.length(F.regexp_replace("prose", NOT_WORD, ""))
    vacant = (size.between(1, 2)) & (F.size(F.split(F.trim("w"), " +")) >= 8)
    place = F.coalesce(F.nullif("url", F.lit("")), F.when(F.size("title_terms") > 0, F.concat(F.lit("#"), F.col("doc_id").cast("string"))))
    d = d.select(
        "doc_id", F.coalesce(F.nullif(F.lower(F.regexp_extract("url", r"https?://([^/:]+)", 1)), F.lit("")), F.col("source"), F.lit("?")).alias("host"),
        (F.coalesce(_long("marks"), F.lit(0)) >= F.greatest(F.lit(1.0), p.share * F.col("n"))).alias("placeholder"),
        (
            F.when(F.col("latin").isNotNull(), _long(F.transform("latin", lambda m: F.replace(m, F.lit(" "), F.lit("")))) >= p.filled * letters_of).otherwise(False)
            | F.coalesce(short & ((size >= 6) & F.array_contains("all", "fox") & (part(PANGRAMS) >= 0.9) | vacant | holds(FILLERS) & (part(f"{FILLERS}|{SUPPORTS}") >= p.covered)), F.lit(False))
        ).alias("filler"),
        F.round(phrase(ERRORS), 6).alias("error"), F.round(phrase(SCRIPT), 6).alias("script"), F.coalesce(little, F.lit(False)).alias("little"), place.alias("place"),
        F.coalesce(~F.arrays_overlap("slug", "body") & ~F.arrays_overlap("title_terms", "body"), F.lit(False)).alias("apart"),
        F.when(little & place.isNotNull() | holds(ERRORS) | holds(SCRIPT), F.xxhash64(F.array_join(F.array_sort(F.array_distinct(F.transform("body", lambda t: F.regexp_replace(t, r"\p{Nd}+", "0")))), " "))).otherwise(F.xxhash64(F.lit("long"), "doc_id")).alias("skeleton"),
    )
    return d.distinct()


def residue(documents: DataFrame, p: Residue = Residue(), address: str | None = None) -> DataFrame:
    """(doc_id, residue, reasons, copies): one row for each doc_id and different finding.

    documents: doc_id, source, text, and `address`, the name of the column that holds the address, if there is one. reasons, sorted: canned,
    error_page, filler, placeholder, script_notice. copies: places (addresses; doc_ids of titled texts without one) where the host gives
    the skeleton. Null, empty and blank texts are no residue, nor is a text of one or two words for being repeated; texts
    of null source count under the host '?'; repeated rows count once; an empty table gives an empty result."""
    d = cut(features(documents, p, address))
    counts = d.where("place is not null").groupBy("host", "skeleton").agg(F.count_distinct("place").alias("copies")).where(F.col("copies") >= p.copies)
    seen = d.join(counts, ["host", "skeleton"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    again = F.col("copies") >= p.copies
    told = lambda c: (F.col(c) >= p.covered) | again & (F.col(c) >= p.repeated)
    canned = F.col("little") & F.col("place").isNotNull() & F.col("apart") & again
    named = [F.when(x, F.lit(n)) for n, x in (("canned", canned), ("error_page", told("error")), ("filler", F.col("filler")), ("placeholder", F.col("placeholder")), ("script_notice", told("script")))]
    reasons = F.concat_ws(",", *named)
    return seen.select("doc_id", (reasons != "").alias("residue"), reasons.alias("reasons"), "copies").distinct()


def clean(documents: DataFrame, p: Residue = Residue(), address: str | None = None) -> DataFrame:
    """The documents, all columns, but for those with a text that is residue."""
    bad = residue(documents, p, address).where("residue").select(F.col("doc_id").alias("_bad"))
    return documents.join(bad.distinct(), F.col("_bad").eqNullSafe(documents["doc_id"]), "left_anti")


def sql(documents: str = "documents", p: Residue = Residue()) -> str:
    """residue as DuckDB's SQL: the same patterns, which RE2 reads alike."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    words = lambda x: f"' ' || trim(regexp_replace(lower({x}), {q(NOT_WORD)}, '  ', 'g')) || ' '"
    terms = lambda x: f"list_filter(list_distinct(string_split(trim(regexp_replace(lower({x}), {q(NOT_WORD)}, ' ', 'g')), ' ')), lambda t: len(t) > 0)"
    found = lambda x, pattern: f"len(replace(array_to_string(regexp_extract_all({x}, {q(pattern)}), ''), ' ', ''))"
    part = lambda pattern, x="w": f"({found(x, pattern)} / greatest(len(replace({x}, ' ', '')), 1))"
    both = lambda pattern: f"{pattern}|{SUPPORTS}"
    phrase = lambda pattern: f"CASE WHEN short AND regexp_matches(w, {q(pattern)}) THEN greatest({part(both(pattern))}, CASE WHEN regexp_matches(tw, {q(pattern)}) THEN {part(both(pattern), 'tw')} ELSE 0 END) ELSE 0 END"
    blank = lambda x: f"nullif(trim(regexp_extract(bare, {q(x)}, 1)), '')"
    return f"""WITH a AS (SELECT DISTINCT doc_id, source, coalesce(text, '') AS text FROM {documents}),
b AS (SELECT doc_id, source, regexp_extract(text, {q(URL)}) AS url, regexp_replace(text, {q(FENCED)}, ' ', 'g') AS prose, len(text) AS n FROM a),
c AS (SELECT *, n BETWEEN 1 AND {p.page} AS short, regexp_replace(prose, 'https?://[^ \t\r\n]+', ' ', 'g') AS bare FROM b),
d AS (SELECT *, coalesce({blank(HEADING)}, {blank(TAGGED)}, {blank(FIRST)}, '') AS title FROM c),
e AS (SELECT *, {words("bare")} AS w, {words("title")} AS tw,
  CASE WHEN title <> '' AND strpos(bare, title) > 0 THEN substr(bare, 1, strpos(bare, title) - 1) || ' ' || substr(bare, strpos(bare, title) + len(title)) ELSE bare END AS rest FROM d),
f AS (SELECT *, {terms("rest")} AS body, {terms("bare")} AS terms, {terms("title")} AS title_terms, list_filter({terms("regexp_extract(url, 'https?://[^/]+(/.*)', 1)")}, lambda t: NOT regexp_matches(t, '^\\p{{Nd}}+$')) AS slug FROM e),
g AS (SELECT DISTINCT doc_id, coalesce(nullif(lower(regexp_extract(url, 'https?://([^/:]+)', 1)), ''), source, '?') AS host,
  coalesce(len(array_to_string(regexp_extract_all(prose, {q(PLACEHOLDER)}), '')), 0) >= greatest(1.0, {p.share} * n) AS placeholder,
  (regexp_matches(prose, '(?i)ipsum|consectetu|eiusmod|incididunt') AND {found(words("prose"), LATINS)} >= {p.filled} * len(regexp_replace(prose, {q(NOT_WORD)}, '', 'g')))
  OR (short AND ((len(terms) >= 6 AND list_contains(terms, 'fox') AND {part(PANGRAMS)} >= 0.9) OR (len(terms) BETWEEN 1 AND 2 AND len(regexp_split_to_array(trim(w), ' +')) >= 8) OR (regexp_matches(w, {q(FILLERS)}) AND {part(both(FILLERS))} >= {p.covered}))) AS filler,
  round({phrase(ERRORS)}, 6) AS error, round({phrase(SCRIPT)}, 6) AS script, short AND len(terms) BETWEEN {p.least} AND {p.few} AS little,
  coalesce(nullif(url, ''), CASE WHEN short AND len(title_terms) > 0 THEN '#' || doc_id END) AS place, NOT list_has_any(slug, body) AND NOT list_has_any(title_terms, body) AS apart,
  CASE WHEN (short AND len(terms) BETWEEN {p.least} AND {p.few} AND coalesce(nullif(url, ''), CASE WHEN len(title_terms) > 0 THEN '#' END) IS NOT NULL) OR (short AND (regexp_matches(w, {q(ERRORS)}) OR regexp_matches(w, {q(SCRIPT)}))) THEN array_to_string(list_sort(list_distinct(list_transform(body, lambda t: regexp_replace(t, '\\p{{Nd}}+', '0', 'g')))), ' ') ELSE '#' || doc_id END AS skeleton FROM f),
h AS (SELECT host, skeleton, count(DISTINCT place) AS copies FROM g WHERE place IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT place) >= {p.copies}),
i AS (SELECT g.*, coalesce(h.copies, 1) AS copies, h.copies IS NOT NULL AS again FROM g LEFT JOIN h ON g.host = h.host AND g.skeleton = h.skeleton),
j AS (SELECT doc_id, copies, concat_ws(',', CASE WHEN little AND place IS NOT NULL AND apart AND again THEN 'canned' END, CASE WHEN error >= {p.covered} OR (again AND error >= {p.repeated}) THEN 'error_page' END,
  CASE WHEN filler THEN 'filler' END, CASE WHEN placeholder THEN 'placeholder' END, CASE WHEN script >= {p.covered} OR (again AND script >= {p.repeated}) THEN 'script_notice' END) AS reasons FROM i)
SELECT DISTINCT doc_id, reasons <> '' AS residue, reasons, copies FROM j"""
