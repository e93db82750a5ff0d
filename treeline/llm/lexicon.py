"""Word lists and text normalisation of the abuse scorer."""

from __future__ import annotations

import re
import unicodedata

#: General word lists per kind, all languages together; stems end with '*'. They name what is abusive anywhere: no
#: word is listed because of the texts at hand. What a corpus adds (names of groups, turns of phrase) is learned from the labels.
INSULTS = """
idiot* moron* imbecil* imbécil* cretin* crétin* halfwit* dimwit* dumbass* jackass* asshole* arsehole* bastard* wanker* twat*
prick dickhead* loser* scumbag* retard* stupid* pathetic worthless useless clown* fool* sucker* shithead* bitch* cunt* slut*
whore* stfu gtfo kys shit* fuck* fck* fuk* motherfuck* bullshit crap trash garbage filth* ugly disgusting brainless dumb dumber
vollidiot* trottel* arschloch* depp* dummkopf* scheiß* scheiss* fresse wichser* schlampe* missgeburt*
connard* connasse* salope* abruti* débile* putain merde bouffon* enculé*
mierda gilipollas pendej* cabrón* puta puto estúpid* cállate inútil* idiota*
идиот* дурак* тварь ничтожеств* урод* мудак* сука суки дебил* придурок* заткнись блядь хуй* пизд* дерьмо
غبي غبية أحمق حمار اخرس حقير بیوقوف بےوقوف گدھا گدھے کمینہ کمینے احمق
बेवकूफ़ बेवकूफ गधा गधे कमीना कमीने मूर्ख हरामी
멍청이* 바보* 쓰레기* 닥쳐 병신* 새끼*
ηλίθι* βλάκα* μαλάκα* ανόητ* άχρηστ* σκάσε κάθαρμα
""".split()
DEHUMANISING = """
vermin scum rats rat parasites subhuman* filthy inferior abschaum ungeziefer untermensch* vermine basura escoria мразь отребье
животные حثالة حشرات गंदगी گندگی 벌레* σκουπίδια
""".split()
GROUPS = """
foreigner* immigrant* refugee* migrant* women jews muslims gays blacks gypsies ausländer* flüchtling* étrangers extranjeros чужаки أجانب विदेशी 외국인
""".split()
SEXUAL = """
sex porn porno nude* naked tits boobs horny cock pussy cum dick xxx webcam* undress* blowjob orgasm* moan* erotic
nackt geil nue nus nues desnud* голые голая трах* عارية नंगी 알몸 ننگی γυμν*
""".split()
THREATS = """
kill killed die death dead burn burns beat beaten shoot hang hanged rape stab bury buried drown hurt murder töten umbringen tuer crever
matar muere morir убью сдохни найду سأقتلك मार مار 죽어 죽여 σκοτώσω
""".split()
SECOND = """
you your yours yourself u ya du dich dir dein deine deinen sie ihr euch tu te toi ton ta vous votre tú te ti tu usted eres ты тебя тебе твой твоя вы
أنت انت أنتم तू तुम आप تو تم 너 너는 넌 니가 당신 εσύ σου σε είσαι
""".split()
FIRST = "i my me myself ich mich je moi yo я मैं أنا میں 나 나는 εγώ".split()
#: The same for scripts written without spaces; matched as substrings.
SPACELESS = {
    "insult": "白痴 蠢货 傻逼 笨蛋 废物 滚开 滚蛋 闭嘴 混蛋 王八蛋 贱人 垃圾 馬鹿 バカ ばか 死ね クズ 黙れ 間抜け うざい きもい โง่ ควาย ไอ้ หุบปาก สารเลว ขยะ 你妈".split(),
    "group": "害虫 人渣 下等 低人一等 蛆虫 畜生 外国人".split(),
    "sexual": "裸照 做爱 色情 性爱 脱光 裸体 裸 エロ セックス เปลือย โป๊ เซ็กซ์ นู้ด".split(),
    "threat": "杀了 弄死 砍死 宰了 去死 殺す 殺して ぶっ殺 ฆ่า ตาย กระทืบ".split(),
    "second": "你 您 你们 お前 あなた 君 貴様 てめえ มึง แก คุณ เธอ".split(),
}
#: Look-alike letters (Cyrillic and Greek to Latin).
LOOKALIKE = str.maketrans("асеорхуіјѕԁһктмнвАСЕОРХУІЈКТМНВαοερνικτ", "aceopxyijsdhktmhbACEOPXYIJKTMHBaoepvikt")
LEET = str.maketrans("013457@$!", "oieastasi")

_WORD = re.compile(r"[^\W_]+(?:[’'][^\W_]+)*", re.U)
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u180e]")
_SPLIT_LETTERS = re.compile(r"(?<![^\W_])[^\W\d_]([ .·•*_\-])[^\W\d_](?:\1[^\W\d_])+(?![^\W_])")
_INNER = re.compile(r"(?<=[^\W\d_])[\-·•‧](?=[^\W\d_])|(?<=[ऀ-ॿ฀-๿])[\-·•‧](?=[ऀ-ॿ฀-๿])|(?<=[ऀ-ॿ])[\-·•‧]")
_MASKED = re.compile(r"(?<![^\W_])[^\W\d_]\*{2,}[^\W\d_]?(?![^\W_])|[^\W\d_]+\*+[^\W\d_]+")
_LEETWORD = re.compile(r"(?<![\w.\-/=@$])(?=[A-Za-z0-9@$]*[A-Za-z])(?=[A-Za-z0-9@$]*[013457@$])[A-Za-z0-9@$]{3,14}(?![\w.\-/=])")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_LATIN, _CYR = re.compile("[a-zA-Z]"), re.compile("[Ͱ-ϿЀ-ӿ]")
SPACELESS_CHAR = re.compile("[぀-ヿ㐀-鿿฀-๿]")


def plain(text: str) -> tuple[str, int]:
    """Text with disguises undone (case kept) and the number of disguised places."""
    n = 0
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if _INVISIBLE.search(text):
        text, k = _INVISIBLE.subn("", text)
        n += k
    if _LATIN.search(text) and _CYR.search(text):
        def same(m: re.Match) -> str:
            nonlocal n
            w = m.group()
            if _LATIN.search(w) and _CYR.search(w):
                n += 1
                return w.translate(LOOKALIKE)
            return w
        text = _WORD.sub(same, text)
    def joined(m: re.Match) -> str:
        nonlocal n
        n += 1
        letters = m.group()[::2]
        article = m.group(1) == " " and letters[0] in "aAI" and len(letters) > 4  # "a h a l f w i t"
        return f"{letters[0]} {letters[1:]}" if article else letters
    text = _SPLIT_LETTERS.sub(joined, text)
    if _LEETWORD.search(text):
        def unleet(m: re.Match) -> str:
            nonlocal n
            w = m.group()
            if re.fullmatch(r"[A-Za-z]{1,2}\d+|\d+[A-Za-z]{1,3}|[vV]\d.*", w):  # A7, 91ms, v2
                return w
            n += 1
            return w.translate(LEET)
        text = _LEETWORD.sub(unleet, text)
    if "*" in text:
        text, k = _MASKED.subn(" maskedword ", text)
        n += k
    text, k = _STRETCH.subn(r"\1", text)
    n += k
    return text, n


def inner_marks(text: str) -> tuple[str, int]:
    """Hyphens and dots between letters removed: every such word joined."""
    return _INNER.subn("", text)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def matcher(entries: list[str]):
    """Membership test for words: exact entries by set, stems by prefix."""
    exact = {e for e in entries if not e.endswith("*")}
    stems = tuple(e[:-1] for e in entries if e.endswith("*"))
    return lambda w: w in exact or w.startswith(stems)
