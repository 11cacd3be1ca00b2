"""Training of the personal-data tagger of problem 1: generated texts with known spans, and the fit.

Run `python -m notelake.llm.p1_training NOTES.parquet NAME_PARTS.parquet OUT.npz`. Spans are known because the texts are
made here: values of each kind, of many shapes, stand in free contexts of four languages, or at random places of real
sentences, among sentences of the notes that show no sign of personal data, and beside numbers, handles, places and
streets that are none. Nothing is labelled by patterns of the notes. At most `sample` notes lend their sentences; at
query time only the fitted tagger runs.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np

from notelake.llm.tagger import KINDS, Tagger, TaggerConfig, train


@dataclass(frozen=True)
class TrainingConfig:
    sample: int = 9_000      # notes whose sentences serve as surroundings, at most
    texts: int = 30_000      # generated texts
    seed: int = 3


# Common names.
GIVEN = """Maria Anna Peter Joanna Harold Thomas Laura David Emma Lukas Sophie Pierre Claire Jean Camille Hans Jürgen Ursula Klaus Petra Stefan Monika
James Mary Robert Linda Michael Susan William Karen Elena Carlos Lucia Diego Marta Pablo Giulia Marco Chiara Luca Olga Ivan Natasha Priya Arjun Mei Wei
Fatima Omar Aisha Yusuf Kwame Ama Ingrid Lars Astrid Björn Zoë Noah Olivia Ethan Chloé François Hélène Élodie Benoît Agnès Jörg Bärbel""".split()
FAMILY = """Gonzalez Schulz Becker Vance Whitfield Smith Johnson Brown Taylor Wilson Clarke Hughes Müller Schmidt Schneider Fischer Weber Wagner Hoffmann Krause
Martin Bernard Dubois Moreau Laurent Lefebvre Girard Mercier Rossi Bianchi Romano Garcia Fernandez Lopez Silva Santos Costa Kowalski Nowak Novak Petrov Ivanova
Hansen Larsen Nielsen Lindqvist Jansen Visser Patel Sharma Khan Nguyen Tran Kim Park Chen Wang Okafor Mensah O'Brien McCarthy O'Neil Saint-Clair Grünwald Weiß""".split()
KANJI_FAMILY = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 斎藤 清水 山崎 森 池田 橋本 阿部 石川 前田 藤田 小川 岡田 長谷川 村上 近藤 石井 遠藤 青木 坂本 福田 西村 太田".split()
KANJI_GIVEN = "太郎 花子 一郎 健 美咲 翔太 陽菜 大輔 恵子 由美 直樹 拓也 真由美 健太 愛 優子 誠 裕子 浩 明美 智子 和也 結衣 蓮 葵 悠斗 凛 陽翔 芽衣 大翔".split()
#: Heads and tails of made-up names in the manner of real ones.
MADE_UP = {
    "given": ("Al Be Ca Da El Fe Ge Ha Is Jo Ka Li Mi Na Ol Pa Ra Si Ta Va Wi Ye Zo Ber Mar Ros Sol Del Gis Win Des Gre Hed Hil Ir Lor Mag".split(), "lina phie nne rick mund bert tta ela isse ette ander vin las dor lia rina gunde wig nette cia ra lle an or iel mine ène phine lind fred".split()),
    "family": ("Har Pem Thor Ash Lin Mar Cal Tan Ost Bran Vas Gar Ber Cas Dal Fen Gil Hol Ken Lam Mont Nor Pel Ros Sal Tem Ven Wal Aber Bell Cran Drum Ell Fair Hath".split(), "ton bury well man berg etti ini eau ier elli ova ez sson ley field wood worth ford ham land stein bach mann hart ard et in ot ac son thal dran chet reaves down".split()),
}
KANJI_POOL = {"family": "三浦野平大小中上下村田川山本木林森石岩島崎原井沢橋谷岡松竹藤宮内西東北南高水金杉菊桑", "given": "真理健司子美一太郎恵雄香奈裕介翔優花直樹和正義明光春夏秋千里佳代洋哲男"}
TOWNS = "Springfield London Leeds Dover Bristol Oxford Boston Salem Austin Reading Berlin Hamburg München Köln Leipzig Ulm Essen Bonn Paris Lyon Nantes Lille Dijon Tours Rouen Madrid Porto Turin Vienna Zürich".split()
KANJI_TOWNS = "横浜市 川崎市 札幌市 仙台市 福岡市 広島市 千葉市 大阪市 京都市 神戸市 名古屋市 東京都千代田区 東京都港区 東京都新宿区 大阪市北区 京都市左京区".split()
KANJI_AREAS = "本町 中央 緑町 桜木町 元町 栄 丸の内 神南 西新宿 南青山 北山 東山 河原町 青葉台 若葉 旭町".split()
STREET_KINDS = "Street Road Lane Avenue Close Row Way Court Drive Terrace Hill Crescent Place Square Gardens St. Rd. Ave. Ln. Dr. Cl. Ct. St Rd Ave".split()
ROLES = {
    "en": "the clerk;the gardener;our neighbour;the choir;the landlord;the committee;a visitor;the caretaker;the night class".split(";"),
    "de": "die Buchhaltung;der Gärtner;unser Nachbar;der Chor;das Team;die Vermieterin;der Hausmeister".split(";"),
    "fr": "la mairie;le jardinier;notre voisin;le chœur;le comité;la locataire;le gardien".split(";"),
    "ja": "庭師;司書;大家;隣の人;合唱団;委員会;船長;配管工;受付係".split(";"),
}
THINGS = {
    "en": "the piano;the keys;the parcel;a ladder;the invoice;the spare lamp;the old radio;two chairs;the garden gate;the form".split(";"),
    "de": "die Schlüssel;das Paket;die Leiter;die Rechnung;die Lampe;das Formular;das alte Radio;die Stühle".split(";"),
    "fr": "les clés;le colis;l’échelle;la facture;la lampe;le formulaire;la vieille radio;deux chaises".split(";"),
    "ja": "鍵;荷物;脚立;請求書;ランプ;申込書;ラジオ;椅子".split(";"),
}
# Contexts: {N} a name, with a title at times; {F} one without; {E} e-mail, {P} phone, {A} address, {I} identity number, {R} role, {T} thing,
# {O} a number of another kind, {L} a place, {S} a street. What stands outside the first five is no case.
CONTEXTS = {
    "en": """Ask {N} about {T}.|Please ask {N} first.|Contact {N}, {E} or {P} for {T}.|Contact {N} at {E}.|According to {N}, {T} was sold.|As {N} said, {T} is late.|{T} belongs to {N} now.|We gave {N} {T} and a coat.
I met {N} in {L} yesterday.|Yesterday {N} called.|{N} borrowed {T}.|{N} left {T} here.|{N}'s {R} called.|{N}'s bicycle is outside.|This is {N}'s desk.|Signed, {F}|Regards, {F}|Best wishes,
{F}|Thanks, {F}!|Dear {N},|Hi {F},|{F} and {F} will be there.|The letter is from {N}.|It was {N} who wrote it.|{N} is away until noon.|Did {N} pay?|Tell {N} to wait.|My sister {F} likes {T}.|Invoice to {N}, {A}.|{N} lives at {A}.
Write to {E}.|Write to {E} or call {P}.|E-mail: {E}|mailto:{E} still works.|My address is {E}, not the old one.|Reply to {E} please.|Send {T} to {E} by noon.|({E})|Mail {E} and {E}.|<{E}> bounced.
Call {P} after six.|Call {P}.|Phone: {P}|Tel. {P}|Tel: {P}, ask for {R}.|Ring {P} if it rains.|My number is {P}.|Text me ({P}) when you leave.|Reach us on {P} today.|{P} is always busy.|Mobile {P}, fax {P}|The shop rings back from {P}.|You can get me at {P}, ext. 12.|Hotline {P}|{N}: {P}|{N} ({P})|{N}, {P}|Office {P}, home {P}|Number for the plumber: {P}|{P} or {P}|Fax to {P} today.|Lost? {P}
My passport is {I} for {T}.|Passport no. {I}|Passport: {I}|SSN {I}|Social security number {I}|Her tax number is {I}.|Tax no {I}, expires in May.|The driving licence {I} was found.|National insurance number: {I}|They asked for the passport ({I}) twice.|For the licence they read out {I}.|ID number {I} on the form.|ID card {I}|Renew licence: {I}
Moved to {A}!|We moved to {A} in May.|The flat at {A} is empty.|Deliver {T} to {A} by noon.|Address: {A}|{A}|Old readings from {A} are missing.|The key for {A} hangs in the hall.|She lives at {A}.|Send it to {F}, {A}.
Order {O} is on its way.|Part {O} failed again.|ISBN {O} is out of stock.|Ping @{H} about build {O}.|Build {O} is green.|Version {O} is out.|Order no. {O}|Invoice {O} is paid.|Model {O} in grey.|Ticket {O}|Serial number {O}|Tracking {O} says delivered.|Batch {O} of 2019
{S} in {L} was closed.|Turn into {S} near {L}.|{L} is quiet.|The road to {L} is flooded.|{R} from {L} paid 52 for {T}.|It costs {K} per week in {L}.|Meet at {K} near {S}.|@{H} knows.|See {L} Museum, room {K}.|My plan for {L}: {T} and {K} metres of rope.|Our {T} from {L}!|In {L} {R} paid for {T}.|On Monday {R} moved {T}.|{T} for {L}|St. {L} and Mt. {L} are far.|the Silver {L} Cup|{L} {K} painted {T} {L} {K} rusty {T} {K}|{K} boxes, {K} lids, {L} {K}|Next to {S} in {L} we found {T}.|Total {Q} bricks.|Total {Q}|{Q} people saw {T}.|It has {Q} pages.|The software is at {O}.|Release {O} is out.|{R}'s bicycle is old.|Today's list is long.|The owner's car|Monday's paper|{T} of the day before.
My ID number is {I} for {T}.|ID number {I}|Please give {I} as your ID number.|Identity card no. {I}|The ID is {I}.|Note the passport number {I} before you go.|Insurance no. {I} was read out.""",
    "de": """Kontakt: {N}, {E}, {P} wegen {T}.|Kontakt: {N}|Bei {N} nach {T} fragen.|{N} hat {T} ausgeliehen.|Laut {N} ist {T} verkauft.|{T} gehört jetzt {N}.|Wir gaben {N} {T}.|Gestern rief {N} an.|Bitte {N} fragen.|Gruß, {F}|Mit freundlichen Grüßen
{F}|Liebe {F},|Lieber {F},|Sehr geehrter {N},|{N} wohnt in der {A}.|Ansprechpartner ist {N}.|Das Paket ist von {N}.|Hat {N} bezahlt?|{F} und {F} kommen.|Frag {F}!
Bitte an {E} schicken.|E-Mail: {E}|Schreib an {E}.|Antwort an {E}, nicht an die alte Adresse.|Mail an {E} oder {P}.
Rückruf unter {P} erbeten.|Tel. {P} ab acht Uhr.|Telefon: {P}|Handy {P}|Meine Nummer ist {P}.|Bitte {P} anrufen.|Erreichbar unter {P}.|Fax {P}|{N}: {P}|{N} ({P})|Büro {P}, privat {P}|Nummer des Klempners: {P}
Die Steuer-ID {I} steht im Antrag.|Reisepass {I}|Reisepass-Nr. {I}|Der Ausweis ({I}) ist abgelaufen.|Führerschein: {I}|Versicherungsnummer {I}|Die Sozialversicherungsnummer ist {I}.|Personalausweis {I} liegt bei.
Umzug nach {A}.|Lieferung an {A} bis Mittag.|Adresse: {A}|{A}|Wir wohnen jetzt {A}.|Die Wohnung {A} ist leer.|Schlüssel für {A} hängt im Flur.
Bestellung {O} ist unterwegs.|Teil {O} ist defekt.|Rechnung Nr. {O}|ISBN {O}|Artikel {O} in Grau.|Version {O}|Auftrag {O}
Die {S} in {L} war gesperrt.|{L} ist ruhig.|{R} aus {L} zahlte {K} Euro.|Treffen um {K} in {L}.|@{H} weiß es.|Das kostet {K} pro Woche in {L}.|Am Montag prüft {R} {T}.|In {L} prüft {R} {T}.|{T} für {L}|{L} {K} alte {T} {K}|Zwischen St. {L} und {L}.|Insgesamt {Q} Steine.|{Q} Besucher in {L}.|Die Ausweisnummer lautet {I}.|Steuernummer {I}""",
    "fr": """Contact : {N}, {E} ou {P} pour {T}.|Contact : {N}|Demander à {N} pour {T}.|{N} a emprunté {T}.|Selon {N}, {T} est en retard.|{T} appartient à {N}.|De la part de {N}.|Hier {N} a appelé.|Merci, {F}|Cordialement,
{F}|Chère {F},|Cher {F},|Voir avec {N}.|{N} habite {A}.|C’est {N} qui a écrit.|Est-ce que {N} a payé ?|{F} et {F} viennent.|Donner {T} à {N}.
Écrire à {E}.|Courriel : {E}|Répondre à {E}, pas à l’ancienne.|Envoyer {T} à {E} demain.
Rappeler le {P} ce soir.|Tél. {P}|Téléphone : {P}|Mon numéro est le {P}.|Appeler {P} après six heures.|Portable : {P}|{N} : {P}|{N} ({P})|Bureau {P}|Joindre le plombier au {P}.
Le numéro de sécurité sociale est {I} sur la fiche.|Passeport {I}|Carte d’identité : {I}|Le permis ({I}) est perdu.|Numéro fiscal {I}|Le passeport est {I}.
Livrer au {A} demain.|Adresse : {A}|{A}|Nous habitons {A}.|Le studio du {A} est vide.|Déménagé au {A} !
Commande {O} expédiée.|Pièce {O} en panne.|ISBN {O}|Facture n° {O}|Version {O}|Modèle {O}
La {S} à {L} était fermée.|{L} est calme.|{R} de {L} a payé {K} euros.|Rendez-vous à {K} h à {L}.|@{H} sait.|Cela coûte {K} par semaine à {L}.|À {L}, {R} vérifie {T}.|{T} pour {L}|Lundi {R} déplace {T}.|Au total {Q} briques.|{Q} visiteurs à {L}.|Le numéro du permis est {I}.|N° fiscal {I}""",
    "ja": """担当は{N}、{E}、電話 {P} です。|担当は{N}です。|{T}のことは{N}に聞く。|{N}が{T}を借りた。|{N}から{T}を受け取った。|{T}は{N}のもの。|昨日{N}に会った。|{N}によると{T}は売れた。|{N}へ|{N}と{N}が来た。|連絡先：{F}|署名 {F}|{F}です。よろしくお願いします。|{N}のお宅は{A}です。
連絡は{E}までお願いします。|新しい宛先は {E} です。|メール：{E}|写しを「{E}」へ送った。|{E} に返信した。
電話は{P}です。|携帯{P}へ折り返し。|夜は {P} に掛けてください。|留守なら{P}まで。|電話番号 {P}|TEL {P}|{P}は話し中だ。|{N}（{P}）|会社 {P}|問い合わせ：{P}
申請には旅券番号 {I} が必要。|個人番号（{I}）を控える。|保険証番号は{I}と書いた。|免許証番号 {I}|マイナンバー：{I}|パスポート {I} を確認した。
届け先は{A}です。|引っ越し先は {A} になった。|{A}の鍵を預かった。|住所：{A}|{A}|{A}に住んでいる。
注文番号 {O} を確認した。|型番は{O}です。|伝票番号 {O}|品番 {O} が届いた。|版 {O}
{L}で{T}を見つけた！|次は{L}で{R}と一緒に探した。|{R}は{T}を{K}個数えた。|{L}は静かだ。|{L}の{T}は{K}円です。|@{H} に頼んだ。|{R}さんに聞く。|{R}さんが{T}を運んだ。|お客様と皆様へ。|大工さんと{R}さんが来た。|郵便屋さんに渡した。|合計{Q}個。|縞模様の{T}を借りた。|{T}の様子を見た。|身分証の番号は{I}です。|{I}が旅券の番号。""",
}
TITLES = {"en": "Mr;Mrs;Ms;Dr;Mr.;Mrs.;Ms.;Dr.;Prof.".split(";"), "de": "Herr;Frau;Herrn;Dr.;Prof.".split(";"), "fr": "M.;Mme;Mlle;Dr;Mme.".split(";")}
HONORIFICS = "さん 様 氏 先生 くん ちゃん".split()
#: What a sentence of the notes shows that may hold a case; such ones are no quiet surroundings.
_SIGNS = re.compile(r"@|＠|\[at\]|\(at\)| at \w+ dot |[\d０-９][\d０-９./ )\-－]{5,}|\b(?:Mr|Mrs|Ms|Dr|Herrn?|Frau|Mme|Mlle)\b\.? ?[A-Z]|\bM\. [A-Z]|さん|(?<![模同仕])様(?![子々])|氏|先生|['’]s\b|〒|市")
_OTHER_NUMBER = re.compile(r"^\W*(?:Order|Part|Total|ISBN|Bestellung|Commande|注文番号|型番)|\bbuild\b")
_LANGUAGES = {"ja": re.compile(r"[ぁ-ん]"), "de": re.compile(r"\b(?:der|die|das|und|ist)\b"), "fr": re.compile(r"\b(?:le|la|les|est|une)\b"), "en": re.compile(r"\b(?:the|and|was|is)\b")}


class Maker:
    """Random values of each kind, and texts around them."""

    def __init__(self, texts: list[str], parts: list[tuple[str, str, str]], rng: np.random.Generator) -> None:
        self.rng = rng
        latin = [p for p, _, s in parts if s == "latin"]
        self.known = {p.lower() for p in latin}
        self.latin = {role: [p for p, r, s in parts if s == "latin" and r == role] for role in ("given", "family")}
        self.heads = sorted({p[:k] for p in latin for k in (3, 4, 5)})
        self.tails = sorted({p[-k:] for p in latin for k in (2, 3, 4, 5)})
        kanji = [(p, r) for p, r, s in parts if s == "kanji"]
        self.kanji = {role: [p for p, r in kanji if r == role] for role in ("given", "family")}
        self.letters = {role: (sorted({p[0] for p in ps}), sorted({p[-1] for p in ps})) for role, ps in self.kanji.items()}
        self.quiet: dict[str, list[str]] = {k: [] for k in (*_LANGUAGES, "other")}
        self.places: dict[str, set[str]] = {"latin": set(TOWNS), "ja": set()}
        for t in texts:
            self.places["latin"].update(re.findall(r"\b(?:in|to|near|from|nach|aus|bei|für|à|de|In|Mt\.|St\.) ([A-Z][a-z]{5,})\b", t))
            self.places["ja"].update(re.findall(r"[一-龠]{2}[谷浜橋原坂町]", t))
        for t in texts:
            for s in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|[\n\r]+", t):
                if (_SIGNS.search(s) and not _OTHER_NUMBER.search(s)) or re.search(r"\b[A-Z]\.$", s) or any(w.lower() in self.known for w in re.findall(r"[A-Za-z]{3,}", s)):
                    continue
                lang = next((k for k, p in _LANGUAGES.items() if p.search(s)), "other")
                pairs = re.findall(r"([A-ZÉ][a-zé]+) ([A-ZÉ][a-zé]+)", s) if lang in ("en", "fr") else []
                if any(len(x) > 3 and y not in self.places["latin"] and not y.endswith("day") for x, y in pairs):
                    continue
                self.quiet[lang] += [s[i:i + 200] for i in range(0, len(s), 200)] if len(s) > 6 else []
        self.places_of = {k: sorted(v) for k, v in self.places.items()}

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def number(self, n: int) -> str:
        return "".join(str(int(x)) for x in self.rng.integers(0, 10, n))

    def syllables(self) -> str:
        w = "".join(self.pick("bcdfghjklmnprstvwz") + self.pick("aeiou") for _ in range(int(self.rng.integers(2, 4)))) + self.pick(["", "n", "r", "s", "th", "ck", "l"])
        return w.capitalize()

    def part(self, role: str) -> str:
        r = self.rng.random()
        if r < 0.45:
            w = self.pick(self.heads) + self.pick(self.tails)
            return w[:1].upper() + w[1:].lower()
        if r < 0.65 and self.latin[role]:
            return self.pick(self.latin[role])
        if r < 0.78:
            return self.pick(GIVEN if role == "given" else FAMILY)
        return self.pick(MADE_UP[role][0]) + self.pick(MADE_UP[role][1]) if r < 0.95 else self.syllables()

    def kanji_part(self, role: str) -> str:
        r = self.rng.random()
        if r < 0.55 and self.kanji[role]:
            return self.pick(self.letters[role][0]) + self.pick(self.letters[role][1])
        if r < 0.7 and self.kanji[role]:
            return self.pick(self.kanji[role])
        if r < 0.85:
            return self.pick(KANJI_FAMILY if role == "family" else KANJI_GIVEN)
        return "".join(self.pick(KANJI_POOL[role]) for _ in range(2 if role == "family" else int(self.rng.integers(1, 4))))

    def name(self, lang: str, full: bool) -> tuple[str, str, str]:
        """What stands before a name, the name, and what stands after it."""
        if lang == "ja":
            after = self.pick(HONORIFICS) if not full or self.chance(0.3) else ""
            gap = "" if not after or self.chance(0.9) else " "
            family = self.kanji_part("family")
            return "", family if not full and self.chance(0.4) else family + self.pick(["", "", " ", "　"]) + self.kanji_part("given"), gap + after
        given, family, initial = self.part("given"), self.part("family"), self.pick("ABCDEFGHIJKLNOPRSTVWYZ" + "M" * (lang != "fr"))
        r = self.rng.random()
        n = given + " " + family if r < 0.5 else f"{initial}. {family}" if r < 0.6 else f"{given} {initial}. {family}" if r < 0.68 else f"{family}, {given}" if r < 0.73 else f"{family}, {initial}." if r < 0.75 else f"{given}-{self.part('given')} {family}" if r < 0.77 else self.pick([given, family])
        title = self.pick(TITLES[lang]) + " " if not full and self.chance(0.4) else ""
        if title and self.chance(0.5):
            n = family
        return title, n.upper() if self.chance(0.04) else n, ""

    def email(self) -> str:
        a, b = self.part("given").lower(), self.part("family").lower()
        a, b = (re.sub(r"[^a-z]", "", w) or "mail" for w in (a, b))
        if self.chance(0.25):
            words = [w for w in re.findall(r"[a-z]{4,}", self.pick(self.quiet["en"] or [""])) if w.isascii()]
            a, b = (self.pick(["info", "office", "team", "post", *words]) for _ in range(2))
        local = self.pick([f"{a}.{b}", f"{a[0]}{b}", f"{a}{b}", f"{a}-{b}", f"{b}_{self.number(2)}", a, f"{a}+list", f"{a}.{b}{self.number(2)}", f"{a}.{b}+{self.pick(['list', 'news', 'shop'])}"])
        stem = self.syllables().lower() + self.pick(["", "box", "mail", "yard", "desk", "net", "mill", "wave", "-shop"])
        domain = [*self.pick([[], [], [], ["mail"], ["post"], ["lists"]]), stem, self.pick("example test invalid com org net de fr jp co io".split())]
        if self.chance(0.05):
            domain[-1:] = ["co", "uk"]
        at, dot = self.pick([("@", ".")] * 6 + [("＠", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", ".")])
        e = local + at + dot.join(domain)
        return e.upper() if self.chance(0.06) else e

    def wide(self, s: str, p: float) -> str:
        return "".join(chr(ord(c) + 0xFEE0) if "0" <= c <= "9" or c in "()-+" else c for c in s) if self.chance(p) else s

    def phone(self, lang: str) -> str:
        n = self.number
        sep = self.pick(["-", "-", " ", "."])
        s = self.pick([
            lambda: f"+{n(2)} {n(2)} {n(3)} {n(4)}", lambda: f"+{n(3)} {n(2)} {n(3)} {n(4)}", lambda: f"+{n(1)} {n(3)} {n(3)} {n(4)}", lambda: f"+{n(2)} {n(3)} {n(7)}",
            lambda: f"({n(4)}) {n(2)} {n(2)} {n(2)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"0{n(3)}/{n(6)}", lambda: f"0{n(3)}/{n(7)}", lambda: f"0{n(3)} {n(3)} {n(3)}", lambda: f"0{n(2)} {n(4)} {n(4)}",
            lambda: sep.join([n(3), n(4), n(3)]), lambda: sep.join([n(3), n(4), n(4)]), lambda: sep.join(["0" + n(1), n(2), n(2), n(2), n(2)]), lambda: sep.join([n(5), n(2), n(7)]), lambda: sep.join([n(3), n(3), n(4)]),
            lambda: f"0{n(4)} {n(6)}", lambda: f"{n(3)}-{n(4)}", lambda: sep.join(["0" + n(2), n(4), n(4)]), lambda: f"(0{n(3)}) {n(6)}",
        ])()
        return self.wide(s, 0.2 if lang == "ja" else 0.02)

    def identity(self, lang: str) -> str:
        n, up = self.number, lambda k: "".join(self.pick("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(k))
        s = self.pick([
            lambda: f"{up(2)} {n(2)} {n(2)} {n(2)} {up(1)}", lambda: f"{up(2)}{n(6)}{up(1)}", lambda: f"{up(1)}{n(8)}", lambda: f"{up(2)}{n(7)}", lambda: n(12), lambda: n(11), lambda: n(9), lambda: f"{n(4)} {n(4)} {n(4)}",
            lambda: f"{n(2)}/{n(4)}/{n(4)}", lambda: f"{n(3)}-{n(2)}-{n(4)}", lambda: f"{n(3)}-{n(2)}-{n(4)}", lambda: f"{n(2)} {n(3)} {n(3)} {n(3)}", lambda: f"{n(1)} {n(2)} {n(2)} {n(2)} {n(3)} {n(3)}", lambda: f"{up(1)}{n(4)}{up(1)}{n(2)}{up(1)}{n(1)}",
            lambda: "".join(self.pick("0123456789ABCDEFGHJKLMNPRTVWXYZ") for _ in range(9)), lambda: f"{up(1)}{n(3)}-{n(3)}-{n(3)}",
        ])()
        return self.wide(s, 0.05 if lang == "ja" else 0)

    def other(self) -> str:
        """A number of an order, part, book, build or version."""
        n = self.number
        return self.pick([
            lambda: f"{n(3)}-{n(2)}-{n(4)}", lambda: f"{n(3)}-{n(4)}-{n(4)}", lambda: f"{n(3)}-{n(4)}", lambda: f"{n(2)}-{n(4)}", lambda: f"{n(1)}.{n(3)}.{n(4)}", lambda: f"{n(1)}.{n(2)}.{n(1)}", lambda: f"{n(3)}-{n(1)}-{n(4)}-{n(4)}-{n(1)}",
            lambda: n(8), lambda: n(12), lambda: f"{n(4)}-{n(2)}", lambda: f"{self.pick('ABCX')}{n(5)}", lambda: f"{n(4)} {n(4)} {n(4)}", lambda: f"{n(2)}.{n(4)}.{n(4)}", lambda: f"{n(3)} {n(3)} {n(3)}", lambda: f"{n(2)}/{n(4)}/{n(4)}",
        ])()

    def place(self, lang: str) -> str:
        known = self.places_of["ja" if lang == "ja" else "latin"]
        return self.pick(known) if known and self.chance(0.85) else self.pick(KANJI_TOWNS) if lang == "ja" else self.syllables()

    def street(self, lang: str) -> str:
        stem = self.pick([self.syllables(), self.pick("Oak Mill Church Station High Park Elm River Garden School Bridge Downing Baker".split()), self.place("en") if self.chance(0.5) else self.syllables() + self.pick(["gate", "ham", "er", "field"])])
        if lang == "de":
            if self.chance(0.25):
                return self.pick("Am;An der;Auf dem;Auf der;Beim;Im;In der;Zum;Zur;Unter den".split(";")) + " " + self.pick([self.syllables(), "Mühlbach", "Anger", "Linden", "Ufer", "Berg" + self.pick(["e", "hof", ""])])
            return stem.rstrip(".") + self.pick("straße weg gasse allee platz ring ufer damm str. Straße".split()).replace("Straße", "er Straße")
        if lang == "fr":
            kind = self.pick("rue avenue chemin quai place allée impasse boulevard".split())
            return kind + " " + self.pick(["", "de ", "du ", "des ", "de la ", "de l’"]) + stem.replace(" ", "-") + ("-" + self.syllables() if self.chance(0.3) else "")
        return stem + " " + self.pick(STREET_KINDS)

    def address(self, lang: str) -> str:
        n = str(int(self.rng.integers(1, 120)))
        town = self.place(lang)
        if lang == "ja":
            stem = self.pick([self.place("ja")[:2], self.kanji_part("family"), "".join(self.pick(KANJI_POOL["family"]) for _ in range(2))])
            city = stem + self.pick(["市", "市", "市", "市" + self.pick("葵中北南東西") + "区"]) if self.chance(0.7) else self.pick(KANJI_TOWNS)
            area = self.pick([self.place("ja"), self.place("ja"), self.pick(KANJI_AREAS), "".join(self.pick(KANJI_POOL["family"]) for _ in range(2)) + self.pick("町谷浜橋原坂")])
            a, b, c = (str(int(x)) for x in self.rng.integers(1, 60, 3))
            tail = self.pick([f"{a}-{b}-{c}", f"{a}-{b}", f"{a}番{b}号", f"{a}丁目{b}番{c}号", f"{a}丁目{b}-{c}", f"{a}－{b}－{c}"])
            mark = self.pick(["", "", f"〒{self.number(3)}-{self.number(4)} ", f"〒{self.number(3)}-{self.number(4)}"])
            return mark + city + area + self.wide(tail, 0.08)
        if lang == "de":
            return f"{self.street('de')} {n}{self.pick(['', '', '', 'a', ' b'])}, {self.number(5)} {town}"
        if lang == "fr":
            return f"{n}{self.pick(['', '', ' bis', ' ter'])}{self.pick([', ', ', ', ' '])}{self.street('fr')}, {self.number(5)} {town}"
        code = self.pick([lambda: "", lambda: "", lambda: " " + self.number(5), lambda: ", " + self.pick("IL MA CA NY TX OH".split()) + " " + self.number(5), lambda: f" {self.pick('LNSWE')}{self.pick('EW')}{self.number(1)} {self.number(1)}{self.pick('ABDEFGH')}{self.pick('JLNPQR')}"])()
        flat = f"{self.pick(['Flat', 'Flat', 'Apt.', 'Unit'])} {int(self.rng.integers(1, 30))}, " if self.chance(0.35) else ""
        return f"{flat}{n}{self.pick(['', '', '', 'A', 'B', 'C'])} {self.street('en')}, {town}{code}"

    def filled(self, context: str, lang: str) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans = "", []
        for piece in re.split(r"(\{[A-Z]\})", context):
            if not re.fullmatch(r"\{[A-Z]\}", piece):
                out += piece
                continue
            k = piece[1]
            before, value, after, kind = "", "", "", None
            if k in "NF":
                before, value, after = self.name(lang, k == "F")
                kind = "name"
            elif k in "EPIA":
                value, kind = {"E": (self.email, "email"), "P": (lambda: self.phone(lang), "phone"), "I": (lambda: self.identity(lang), "id_number"), "A": (lambda: self.address(lang), "address")}[k]
                value = value()
            else:
                value = {
                    "O": self.other, "L": lambda: self.place(lang), "S": lambda: self.street(lang), "R": lambda: self.pick(ROLES[lang]), "T": lambda: self.pick(THINGS[lang]),
                    "H": lambda: f"{self.syllables().lower()}{self.pick(['dyke', 'haven', 'ham', ''])}-{self.pick(['crew', 'team', 'ops'])}",
                    "Q": lambda: self.pick([f"{self.number(2)} {self.number(3)} {self.number(3)}", f"{self.number(1)},{self.number(3)},{self.number(3)}", f"{self.number(3)} {self.number(3)}", f"{self.number(1)}.{self.number(3)}.{self.number(3)}", self.number(7)]),
                    "K": lambda: self.pick([self.number(2), self.number(3), f"{self.number(2)}.{self.number(1)}", f"{self.number(1)}:{self.number(2)}"]),
                }[k]()
            if not out and value[:1].islower() and k in "RT":
                value = value[:1].upper() + value[1:]
            out += before
            if kind:
                spans.append((len(out), len(out) + len(value), kind))
            out += value + after
        return out, spans

    def dropped_in(self, lang: str) -> tuple[str, list[tuple[int, int, str]]]:
        """A value at a random place of a real sentence, in brackets, commas or bare; numbers with a word that tells what they are."""
        s = self.pick(self.quiet[lang])
        cue = {
            "en": [" {P}", " {P},", " ({P})", " or {P}", " call {P},", " ({E})", ", {A},", " passport {I}", " for {N}", " with {F}", " tel. {P}", " by {F},", ", {N},", " order {O}", " part {O}", " near {S}"],
            "de": [" {P}", " ({P})", " unter {P}", " Tel. {P}", " ({E})", ", {A},", " Ausweis {I}", " für {N}", " mit {F}", ", {N},", " Bestellung {O}"],
            "fr": [" {P}", " ({P})", " au {P}", " tél. {P}", " ({E})", ", {A},", " passeport {I}", " pour {N}", " avec {F}", ", {N},", " commande {O}"],
            "ja": ["{P}", "（{P}）", "、{P}、", "（{N}）", "（{E}）", "、{A}、", "（電話{P}）", "旅券番号{I}", "{N}の", "{N}と", "注文番号{O}"],
        }[lang]
        filler, spans = self.filled(self.pick(cue), lang)
        cuts = [m.start() for m in re.finditer(r" ", s)] if lang != "ja" else [m.end() for m in re.finditer(r"[、はがを]", s)]
        at = self.pick([c for c in cuts if c] or [len(s)])
        return s[:at] + filler + s[at:], [(a + at, b + at, k) for a, b, k in spans]

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        lang = self.pick(["en", "en", "en", "de", "de", "fr", "fr", "ja", "ja", "ja"])
        if self.quiet["other"] and self.chance(0.08):
            return self.pick(["\n", " ", ""]).join(self.pick(self.quiet["other"]) for _ in range(4)), []
        contexts = [c for line in CONTEXTS[lang].split("|") for c in ([line] if "\n{F}" in line else line.split("\n"))]
        out, spans = "", []
        for _ in range(int(self.rng.integers(2, 6))):
            r = self.rng.random()
            if r < 0.5:
                s, own = self.filled(self.pick(contexts), lang)
            elif r < 0.62 and self.quiet[lang]:
                s, own = self.dropped_in(lang)
            else:
                s, own = self.pick(self.quiet[lang if self.chance(0.85) else "other"] or self.quiet[lang] or [""]), []
            joint = self.pick(["", "", "", "\n", "　", " "]) if lang == "ja" else self.pick([" ", " ", " ", "  ", "\n", "\n\n", "\r\n", "\n  ", "\n- "])
            out += joint if out else self.pick(["", "", "", " ", "\t", "- "])
            spans += [(a + len(out), b + len(out), k) for a, b, k in own]
            out += s
        return out, spans


def examples(texts: list[str], parts: list[tuple[str, str, str]], c: TrainingConfig = TrainingConfig()) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) of generated texts."""
    rng = np.random.default_rng(c.seed)
    sample = [texts[int(i)] for i in rng.permutation(len(texts))[: c.sample]]
    maker = Maker(sample, parts, rng)
    return [maker.text() for _ in range(c.texts)]


def main(notes: str, name_parts: str, out: str, steps: str = "2000", workers: str = "8") -> None:
    import pyarrow.parquet as pq

    t = pq.read_table(notes, columns=["content"]).to_pylist()
    texts = sorted({r["content"] for r in t if r["content"]})
    parts = [(r["name_part"], r["part_role"], r["script"]) for r in pq.read_table(name_parts).to_pylist()]
    data = examples(texts, parts)
    print(len(data), "texts", {k: sum(1 for _, s in data for x in s if x[2] == k) for k in KINDS})
    tagger: Tagger = train(data, TaggerConfig(steps=int(steps)), workers=int(workers))
    tagger.save(out)


if __name__ == "__main__":
    main(*sys.argv[1:])
