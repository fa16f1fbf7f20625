"""Template residue and error-page text (problem 1).

Messages and filler are known by what their words do, not by their wording: a page or server
noun with a word of loss, a script noun with a word of need, a text noun with a word of
placing, and so on, in nine languages.  One automaton finds all such words in one pass over a
text; a sentence is residue when its words make up one of these pairs and cover most of it, so
that prose about error pages, scripts or filler isn't.  Unfilled fields are found at their
opening signs and then read in full.  A page is excluded when residue covers a large share of it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.encoding import Plausibility, Repair

# Words by role, one language a line (en de fr es pt nl pl ru ja); * stands for any ending.
ROLES = {
    "page": """
        page pages url address site website web resource link content file document item entry section requested product
        seite seiten adresse website webseite webseiten inhalt inhalte bereich ressource datei angeforderte gewünschte anwendung
        page pages adresse site contenu contenus ressource fichier rubrique recherchée demandée application
        página páginas dirección sitio contenido recurso archivo solicitada aplicación
        página páginas endereço site sítio conteúdo recurso ficheiro arquivo aplicação
        pagina pagina's adres site website inhoud bestand toepassing
        stron* adres* witryn* treść treści zasób plik
        страниц* адрес* сайт* раздел* ресурс* содержим* файл*
        ページ アドレス サイト コンテンツ ファイル""",
    "not": """
        not no cannot can't couldn't doesn't don't isn't wasn't won't never none unable
        nicht kein keine keinen nie nichts leider
        pas plus aucun aucune n' n'a n'avons n'avez n'est n'existe n'êtes ne
        no ya ningún ninguna
        não nenhum nenhuma
        niet geen nergens
        nie brak nic
        не нет нельзя
        ません ない なく""",
    "find": """
        find found exist exists available valid reach reached locate located looking searching offered served
        finden gefunden existiert existieren vorhanden verfügbar erreichbar erreicht gibt
        trouvé trouvée trouver existe disponible accessible
        encontrado encontrada encontramos encontrar existe disponible busca buscas
        encontrado encontrada encontrámos encontramos encontrar existe disponível procura
        vinden gevonden bestaat beschikbaar bereikbaar
        znaleziono znaleźć znaleziona istnieje dostępna dostępny ma
        найдена найден найдено найти существует доступна доступен
        見つかり 存在 利用でき 利用いただけ""",
    "gone": """
        removed deleted moved gone missing expired disappeared vanished discontinued
        gelöscht entfernt verschoben abgelaufen verschwunden
        supprimé* déplacé* disparu* expiré*
        eliminad* borrad* movid* caducad* caducó
        removid* apagad* eliminad* movid* expirou expirad*
        verwijderd verplaatst verlopen verdwenen
        usunięt* przeniesion* wygasł*
        удален* удалён* перемещен* перемещён* истекл* истёк
        削除 移動しました 期限切れ 有効期限""",
    "access": """
        access permission permissions authorized authorised allowed rights
        zugriff zugang berechtigung berechtigt befugt
        accès autorisé autorisée autorisation droit permission consulter
        acceso permiso autorización autorizado autorizada
        acesso permissão autorização autorizado autorizada
        toegang toestemming bevoegd
        dostęp dostępu uprawnień uprawnienia
        доступ доступа прав права
        アクセス 権限 閲覧""",
    "denied": """
        denied forbidden unauthorized unauthorised refused blocked rejected banned
        verweigert verboten gesperrt untersagt
        refusé* interdit* bloqué*
        denegad* prohibid* bloquead*
        negad* proibid* recusad*
        geweigerd verboden geblokkeerd
        odmowa odmówiono zabroniony zabronione zablokowan*
        запрещен* запрещён* запрещено отказано закрыт* заблокирован*
        拒否 禁止 ブロック""",
    "error": """
        error errors problem failure fault exception exceptions difficulties wrong oops whoops
        fehler problem störung panne
        erreur erreurs problème incident panne oups
        error problema fallo mal
        erro problema falha mal
        fout probleem storing fouten
        błąd problem awaria
        ошибка ошибке проблема сбой
        エラー 問題 障害 不具合""",
    "happens": """
        occurred occured happened went encountered unexpected internal technical having experiencing unhandled uncaught establishing
        aufgetreten passiert unerwartet* interner internes internen technisch* beim
        survenu* produit* interne inattendu* technique* survient
        ocurrid* producid* interno inesperad* técnic* salió
        ocorreu ocorrid* interno inesperad* técnic* correu
        opgetreden onverwacht* interne technische ging gegaan
        wystąpił* nieoczekiwan* wewnętrzn* techniczn* poszło
        произошл* неожиданн* внутренн* техническ* пошло возникл*
        発生 予期しない 予期せぬ 内部""",
    "server": """
        server servers gateway backend upstream database connection request requests service session host network fetch origin http status code
        server verbindung datenbank anfrage sitzung dienst netzwerk
        serveur serveurs connexion requête session service
        servidor servidores conexión solicitud sesión servicio
        servidor servidores ligação conexão pedido sessão serviço
        server verbinding verzoek sessie dienst
        serwer serwera połączenie połączenia żądanie sesja usługa
        сервер сервера соединение запрос сессия сервис
        サーバー サーバ 接続 リクエスト セッション サービス""",
    "fails": """
        failed failing timeout timed overloaded down unavailable offline suspended crashed invalid bad responding respond answer exceeded many
        antwortet überlastet abgebrochen unterbrochen fehlgeschlagen
        répond surchargé* échoué interrompu* indisponible* momentanément introuvable*
        responde sobrecargad* falló fallado interrumpid*
        responde sobrecarregad* falhou indisponíve* interrompid*
        reageert overbelast mislukt onbeschikbaar
        odpowiada przeciążon* niedostępn* nieudan*
        отвечает перегружен* прерван* недоступ*
        応答 タイムアウト 混み合""",
    "works": """
        maintenance construction
        wartung wartungsarbeiten gewartet bauarbeiten aufbau
        maintenance entretien construction travaux
        mantenimiento construcción obras
        manutenção construção obras
        onderhoud aanbouw opbouw onderhoudswerk*
        konserwacj* budowie przebudowie przerwa
        обслуживани* разработке реконструкции работы
        メンテナンス 工事中 準備中""",
    "soon": """
        temporarily currently soon shortly moment moments later seconds minutes briefly
        vorübergehend momentan derzeit bald später kürze
        temporairement momentanément actuellement bientôt tard instants
        temporalmente momento pronto tarde
        temporariamente momento brevemente breve tarde
        tijdelijk momenteel binnenkort later straks
        tymczasowo chwilowo wkrótce później chwil*
        временно скоро позже позднее
        一時的 現在 まもなく しばらく 後ほど""",
    "retry": """
        try retry reload refresh again return returning
        versuchen versuche erneut neu lade laden aktualisieren
        réessayer réessayez essayez rechargez recharger actualisez
        intente inténtelo intentar nuevo cargar recargue recargar actualice vuelva
        tente tentar atualize recarregue novamente vez
        probeer opnieuw vernieuw herlaad
        spróbuj ponownie odśwież raz
        попробуйте повторите обновите снова перезагрузите попытку
        再読み込み もう一度 再度 お試し""",
    "script": """
        javascript script scripts scripting
        skripte skripten skript
        scripts
        scripts
        scripts
        scripts
        skryptów skrypty skrypt
        скрипты скриптов
        スクリプト ジャバスクリプト""",
    "needs": """
        enable enabled enabling activate activated allow turn turned switch switched needs need requires require required must disabled off support supported supports
        aktivieren aktiviert einschalten eingeschaltet benötigt erforderlich deaktiviert unterstützt muss braucht
        activer activez activé* exige nécessite désactivé* besoin doit requis
        activar active activado activa habilite habilitar necesita requiere desactivado debe
        ative ativar ativado habilite precisa preciso requer desativado ligar deve
        schakel ingeschakeld inschakelen nodig vereist uitgeschakeld moet zet
        włącz włączon* włączyć wymaga wyłączon* musi
        включите включить требуется требует нужен нужны отключен отключён отключены
        有効 オン 必要 無効""",
    "browser": "browser browsers browsers' navigateur navegador navegadores przeglądark* przeglądarce браузер* ブラウザ",
    "checking": "checking verifying loading überprüft überprüfen vérification vérifions verificando comprobando controleren sprawdzamy проверяем проверка 確認しています",
    "blank": """
        text paragraph headline heading title subtitle copy words caption lines subheading content block body
        text überschrift titel absatz untertitel texte
        texte titre paragraphe textes sous-titre intitulé
        texto título párrafo titular
        texto título parágrafo
        tekst titel kop alinea koptekst
        tekst tytuł akapit nagłówek
        текст заголовок абзац
        テキスト 文章 見出し タイトル""",
    "mock": """
        placeholder placeholders dummy sample filler
        platzhalter platzhaltertext blindtext mustertext beispieltext fülltext
        remplissage provisoire fictif exemple faux
        relleno provisional ejemplo ficticio
        preenchimento provisório exemplo fictício
        voorbeeldtekst opvultekst tijdelijke vultekst
        zastępczy przykładowy tymczasowy
        заполнитель пример временный рыба
        ダミー サンプル 仮の""",
    "put": """
        insert type enter add write goes paste put
        einfügen eingeben geben schreiben fügen steht tragen
        saisir saisissez écrivez écrire ajoutez insérez
        escriba escribe introduzca añada inserte
        escreva introduza adicione insira
        vul typ voeg schrijf plaats zet
        wpisz dodaj wstaw
        введите добавьте вставьте напишите будет
        入力 追加""",
    "swap": """
        replace edit change
        ersetzen ersetze bearbeiten ändern
        remplacez remplacer modifier modifiez
        sustituya sustituir editar editarlo cambie
        substitua substituir editar altere
        vervang vervangen bewerk bewerken
        zastąp zastąpić edytować
        замените заменить изменить
        差し替え 編集""",
    "here": "here hier ici aquí aqui tutaj tu здесь ここ",
    "your": "your own ihr ihren ihre ihrem eigenen votre vôtre su tu seu sua uw eigen swój twój własny ваш свой",
    "click": "click klicken klicke cliquez clic clique klik kliknij нажмите クリック",
}
# Words that say nothing; they count neither for nor against a sentence.
EMPTY = frozenset(
    """a an the this that these those it its is are was be been being has have had having will we we're we've you you're your our my i us they to of on in at from for with by and or but so if as up only just please sorry what which who seem seems seen see view use used using run open get back continue contact owner do does did can could may might would should very too any more anymore longer permanently there then right now before after few while
    der die das den dem des ein eine einen einem ein dies diese dieser dieses diesem ist sind war wird werden wurde hat haben hatte sie ihr ihre ihren wir uns es ich zu zum zur von vom auf in im an am mit für und oder aber nur bitte konnten können kann mehr um so wieder diese nutzen anzeigen vor nach
    le la les l' un une des de du d' ce cet cette ces est sont été être a ont avons avez vous nous il elle je en dans sur pour par avec et ou mais si merci veuillez désolé pouvoir seulement votre afficher utiliser
    el la los las un una unos de del al este esta esto es son ha han sido lo le se que en con para por y o pero si sentimos su sus ver usar usted nos
    o os as um uma do da dos das no na este esta isto é são foi está já ao em com para por e ou mas se desculpe que ver usar seu sua apenas lo
    de het een deze dit is zijn was wordt werd er u uw we wij ons om te van op in voor met en of maar alleen slechts konden kunt meer bekijken gebruiken
    ten ta to tę tej tego jest są był została została w z na do i lub ale przepraszamy się udało masz proszę tylko już aby jeszcze wyświetlić
    это этот эта эту этой этому такой в на по с к и или но мы вы у вас вам извините пожалуйста что что-то только вашем смогли находится чтобы то так
    この その は が を に の で と も です ます ました しました してください ください まし いま されました 申し訳 ございません ございませんが ご指定 お探し お客様 ている していません する ため""".split()
)
# Set phrases of programs, filler and machines, whole.
IDIOMS = """
traceback (most recent call last)|stack trace|fatal error|parse error|syntax error|undefined function|sqlstate|nullpointerexception|in handler|lorem ipsum|dolor sit amet|text goes here|headline goes here|your text here|click to edit|under construction|coming soon|to be announced|hello world|test test test|blah blah|asdf|qwer|qwerty|tbd|untitled page|untitled document|sample page|internal server error|bad gateway|too many requests|service unavailable|gateway timeout|not found|access denied|something went wrong|sign in again
""".strip().split("|")
#: What a message or filler consists of: all roles of a row stand in it.
PAIRS = [
    {"page", "not", "find"}, {"server", "not", "find"}, {"blank", "not", "find"}, {"page", "gone"}, {"gone", "not", "find"}, {"server", "gone"}, {"server", "fails"}, {"page", "fails"}, {"server", "denied"}, {"page", "denied"}, {"access", "denied"}, {"access", "not"}, {"error", "happens"}, {"error", "server"},
    {"server", "works"}, {"page", "works"}, {"works", "soon"}, {"works", "fails"}, {"server", "soon", "not"}, {"retry", "soon"}, {"retry", "page"}, {"script", "needs"}, {"script", "not"}, {"script", "browser"}, {"browser", "checking"},
    {"mock", "blank"}, {"mock", "swap"}, {"put", "blank", "here"}, {"put", "blank", "your"}, {"swap", "blank", "your"}, {"swap", "blank", "mock"}, {"blank", "here", "your"}, {"click", "swap"},
]
#: Roles that are enough where a status code of a failed request stands beside them.
BESIDE_CODE = frozenset(("error", "not", "find", "gone", "denied", "fails", "server", "works"))
#: Roles that are enough as a whole sentence of one or two words.
ALONE = frozenset(("denied", "mock", "works", "error"))
#: Roles whose words are rare enough to read a sentence for.
CALLING = frozenset(("find", "gone", "access", "denied", "error", "fails", "works", "retry", "script", "checking", "blank", "mock", "swap", "put"))
WORD_ROLE, IDIOM, OPENING = 0, 1, 2
_CODE = re.compile(r"(?<![\w.,€$£-])[45]\d\d(?![\w€%]|[.,]\d)")
_WORDS = re.compile(r"[\u3040-\u30ff\u3400-\u9fff々ー]+|(?:(?![\u3040-\u30ff\u3400-\u9fff])[^\W\d_])+(?:['-](?![\u3040-\u9fff])[^\W\d_]+)*'?")
_PLACE = re.compile(r"(?:https?://|www\.)\S+|(?<!\w)/[\w./-]+|\S*_\S*")
_EXCEPTION = re.compile(r"\b\w*(?:Error|Exception)\b\s*(?::|$)")
#: A longer sentence isn't a message.
MOST_WORDS, MOST_SIGNS = 34, 260
#: Words of the filler text in mock Latin; a sentence made of them is filler.
MOCK_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Those of them for which a sentence is read: any three words of it in a row hold one nearly always.
LATIN_CALLS = ("lorem", "ipsum", "dolor", "amet", "adipiscing", "eiusmod", "tempor", "labore", "magna", "aliqua", "veniam", "nostrud", "ullamco", "laboris", "aliquip", "commodo", "irure", "velit", "cillum", "fugiat", "pariatur", "occaecat", "deserunt", "mollit")
#: Opening signs of fields that a template should have filled, and what a whole field looks like.
OPENERS = ("{", "<", "$", "%%", "@@", "##", "~~", "__", "xxx_", "[", "*|", "((", "%(", "||", "%")
FIELD = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|\{%[^{}\n]{0,80}%\}|<%[^<>\n]{0,80}%>|[$#]\{[^{}\n]{1,60}\}|\{\$[\w.]{1,60}\}|%%[\w.]{1,60}%%|@@[\w.]{1,60}@@|\[\[[^\[\]\n]{1,60}\]\]|__[A-Za-z][A-Za-z0-9.]*(?:_[A-Za-z0-9.]+)*__"
    r"|XXX_[A-Za-z0-9_.]+_XXX|\[object \w+\]|\[(?:Your|YOUR|Enter|ENTER) [\w .'-]{2,60}\]|\[(?:[Ii]nsert|INSERT|[Aa]dd) [^\[\]\n]{2,60}\]|\[[A-Z][A-Z0-9_.]{3,}(?:[ _][A-Z0-9_.]+)*\]|\[[A-Z]{2,}(?: [A-Z]{2,})+\]|\{\d\}|\{[!#:=]?[A-Za-z][\w.]+\}|\[[a-z]+(?:[A-Z]\w*|[_.]\w+)+\]"
    r"|\*\|[\w.]+\|\*|<(?!(?:a|abbr|b|body|br|code|div|em|h\d|head|html|i|img|li|p|pre|small|span|strong|table|td|tr|u|ul|ol)\b)[A-Za-z]\w*(?:[ _.-]\w+){0,3}>"
    r"|([@#~|+^])\1[A-Za-z][\w.]*\1\1|%[A-Za-z]\w*(?:[._]\w+)*%|%\([\w.]+\)[sd]|\(\([A-Za-z]\w*(?:[._]\w+)*\)\)|\$[a-z]\w*[A-Z_]\w*|\$[A-Z]+_[A-Z_]+"
)
_SENTENCE = re.compile(r"[^\n.!?。！？]+(?:[.!?。！？]+(?=\s|$)|[。！？]+|[.!?](?=\S)[^\n.!?。！？]*)*|[.!?。！？]+")
_TITLE_PART = re.compile(r"\s+[-–|·]\s+")
_EMPTY_TITLE = re.compile(r"(?:undefined|null|nan|none|untitled(?: page| document)?|sample page|test page|new page(?: \d+)?|home copy(?: \d+)?|(?:home|page) copy(?: \d+)?|page title|title|hello world!?)")
_LETTERS = re.compile(r"[^\W_]")
COVERED = 0.6


def _is_cjk(text: str) -> bool:
    return text >= "\u3040"


@dataclass
class Matcher:
    """``calling``: the automaton run over whole texts; ``words``, ``starts``, ``signs``: roles of whole words, of beginnings of words and of runs of CJK signs."""

    calling: object
    words: dict[str, frozenset[str]]
    starts: tuple[tuple[str, str], ...]
    signs: object
    known: dict[str, frozenset[str]]

    def roles(self, word: str) -> frozenset[str]:
        found = self.known.get(word)
        if found is None:
            found = self.words.get(word, frozenset()) | frozenset(role for start, role in self.starts if word.startswith(start))
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = found
        return found


def build() -> Matcher:
    """The automaton over all words that call for a reading, and the roles of all words."""
    import ahocorasick

    words, starts, signs = defaultdict(set), [], defaultdict(set)
    calling, inside = ahocorasick.Automaton(), ahocorasick.Automaton()
    for role, block in ROLES.items():
        for word in block.split():
            stem = word.rstrip("*")
            if _is_cjk(stem):
                signs[stem].add(role)
            elif word.endswith("*"):
                starts.append((stem, role))
            else:
                words[stem].add(role)
            if role in CALLING:
                calling.add_word(stem, (WORD_ROLE, len(stem), word.endswith("*")))
    for word in LATIN_CALLS:
        calling.add_word(word, (WORD_ROLE, len(word), False))
    for idiom in IDIOMS:
        calling.add_word(idiom, (IDIOM, len(idiom), False))
    for opener in OPENERS:
        calling.add_word(opener, (OPENING, len(opener), False))
    for stem in EMPTY:
        if _is_cjk(stem):
            signs[stem] |= set()
    for stem, roles in signs.items():
        inside.add_word(stem, (len(stem), frozenset(roles)))
    for automaton in (calling, inside):
        automaton.make_automaton()
    return Matcher(calling, {w: frozenset(r) for w, r in words.items()}, tuple(starts), inside, {})


def _letters(text: str) -> int:
    return len(_LETTERS.findall(text))


def sentence_is_residue(matcher: Matcher, sentence: str) -> bool:
    """Whether a sentence is a message or filler: its words' roles make up a pair and cover most of its letters, or it is mock Latin."""
    low = sentence.lower().replace("’", "'")
    words = _WORDS.findall(low)
    if len(words) >= 3 and sum(w in MOCK_LATIN for w in words) >= 0.7 * len(words) and any(len(w) > 4 for w in words):
        return True
    if len(words) > MOST_WORDS or len(low) > MOST_SIGNS or not words:
        return False
    idioms = [x for x in IDIOMS if x in low]
    if idioms and sum(_letters(x) * low.count(x) for x in idioms) >= COVERED * sum(len(w) for w in words if w not in EMPTY or any(w in x for x in idioms)):
        return True
    if _EXCEPTION.search(sentence) and len(words) <= 20:
        return True
    # a sentence that names itself at its beginning: a text noun right after a word for filler
    if len(words) > 1 and "mock" in matcher.roles(words[0]) and "blank" in matcher.roles(words[1]) and len(words) <= 14:
        return True
    roles: set[str] = set()
    covered = total = counted = 0
    for word in _WORDS.findall(_PLACE.sub(" ", low)):
        if _is_cjk(word):
            held = bytearray(len(word))
            for end, (size, own) in matcher.signs.iter(word):
                roles |= own
                held[end - size + 1 : end + 1] = (b"\2" if own else b"\1") * size
            covered += held.count(2)
            total += len(word) - held.count(1)
            counted += 3
            continue
        own = matcher.roles(word)
        if "'" in word:
            own = own | matcher.roles(word.split("'")[-1]) | matcher.roles(word.split("'")[0] + "'")
        if own:
            roles |= own
            covered += len(word)
        if own or word not in EMPTY:
            total += len(word)
            counted += 1
    if not total or covered < COVERED * total:
        return False
    if any(pair <= roles for pair in PAIRS):
        return True
    if covered == total and counted <= 3 and ({"not", "find"} <= roles or {"not", "page"} <= roles or {"not", "happens"} <= roles):
        return True
    if counted <= 2 and roles & ALONE and covered == total:
        return "error" not in roles or bool(_CODE.search(low)) or words[0] in ("oops", "whoops", "oups", "exception")
    if roles == {"blank"} and counted <= 3 and len(words) <= 3 and re.search(r"(?:\b(?:one|two|three|four|eins|zwei|drei|un|deux|trois|uno|dos|tres|um|dois|três|een|twee|drie)\b|\d)\W*$", low):
        return True
    return bool(_CODE.search(low)) and counted <= 8 and bool(roles & BESIDE_CODE)


def _joins(text: str, k: int) -> bool:
    """Whether a letter of a spaced script stands at ``k``."""
    return 0 <= k < len(text) and text[k] < "\u3040" and text[k].isalpha()


def judge(matcher: Matcher, title: str | None, text: str) -> tuple[int, float]:
    """``(spots, coverage)``: residue sentences and unfilled fields, and the share of letters they hold."""
    spots, held = 0, 0
    lowered = text.lower()
    hits, opened = [], False
    for end, (kind, size, start) in matcher.calling.iter(lowered):
        if kind == OPENING:
            opened = True
            continue
        a, b = end - size + 1, end + 1
        if lowered[a] >= "\u3040" or not (_joins(lowered, a - 1) or (not start and _joins(lowered, b))):
            hits.append(a)
    if opened:
        fields = [m.span() for m in FIELD.finditer(text)]
        spots += len(fields)
        held += sum(_letters(text[a:b]) for a, b in fields)
    source = text if len(lowered) == len(text) else lowered
    hits += [m.start() for m in _CODE.finditer(lowered)]
    if hits:
        k = 0
        hits.sort()
        for m in _SENTENCE.finditer(source):
            a, b = m.span()
            while k < len(hits) and hits[k] < a:
                k += 1
            if k < len(hits) and hits[k] < b and sentence_is_residue(matcher, m.group()):
                spots += 1
                held += _letters(m.group())
    if title:
        spots += sum(1 for _ in FIELD.finditer(title))
        for part in _TITLE_PART.split(title.strip()):
            spots += bool(_EMPTY_TITLE.fullmatch(part.lower().strip())) or sentence_is_residue(matcher, part)
    return spots, min(1.0, held / max(1, _letters(text))) if held else 0.0


def residue(pages: DataFrame, model: Plausibility, most_covered: float = 0.3) -> DataFrame:
    """One row a page with text: ``fetch_id, spots, coverage, excluded``.

    ``pages`` has fetch_id, title and clean_text.  Wrongly decoded lines are mended before they
    are read.  ``spots`` counts residue sentences and unfilled fields of title and text;
    ``coverage`` is their share of the text's letters; pages at or above ``most_covered`` are
    excluded.  Null and blank texts give no row; null ids are left out; repeated rows count once.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, repair = build(), Repair(Plausibility.of(shared.value))
        for batch in batches:
            found = [judge(matcher, repair.text(t)[1] if t else t, repair.text(x)[1]) for t, x in zip(batch["title"], batch["clean_text"])]
            yield pd.DataFrame({"fetch_id": batch["fetch_id"], "spots": [s for s, _ in found], "coverage": [c for _, c in found]})

    known = pages.select("fetch_id", "title", "clean_text").where(F.col("fetch_id").isNotNull() & (F.trim("clean_text") != ""))
    judged = known.mapInPandas(run, "fetch_id bigint, spots int, coverage double").dropDuplicates(["fetch_id"])
    return judged.withColumn("excluded", F.col("coverage") >= most_covered)
