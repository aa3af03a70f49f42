"""Hand-written sentences, and texts composed of them whose boundaries are known, to train the sentence models on.

The sentences are this library's own. A text is composed by a seeded generator: sentences with their end marks, abbreviations and
numbers inside, quotations with the clause that reports them before or behind, missing spaces, line breaks and empty lines. So
the labels come from how a text was made, not from rules about how it looks.
"""

from __future__ import annotations

import random

#: Sentences without their end mark, by language.
SENTENCES = {
    "en": "The river rose after three days of rain|She keeps the old letters in a blue box|Nobody had told the baker about the wedding|We waited until the lamps went out|A young clerk copied the whole register by hand|They left before sunrise|He could not find the key|It works|Rain fell on the harbour all night|The second volume is missing from the shelf|My brother sold his boat last winter|Most visitors never see the garden|Yes|Then the engine stopped|I did not expect an answer",
    "tr": "Çocuklar bahçede oynuyor|Yarın sabah erken kalkmamız gerekiyor|Kitabı masanın üstüne bıraktım|Annem bize güzel bir hikaye anlattı|Kimse kapıyı açmadı|Şehir geceleri çok sessiz olur|Bu soruya cevap veremedim|Islak taşların üstünde yürüdük|Öğretmen sınıfa girdi|Dün akşam yağmur yağdı",
    "ar": "وصل المسافرون إلى القرية قبل الغروب|كتبت الرسالة ثم مزقتها|لم يجد الطبيب مفتاح البيت|في المدينة سوق قديم يزوره الناس كل يوم|سألت المعلمة عن معنى الكلمة|نام الأطفال بعد العشاء|قرأنا الكتاب كله في ليلة واحدة|لا أعرف من أين جاء الصوت|كان البحر هادئا هذا الصباح|عاد الفلاح إلى حقله متعبا",
    "he": "הילדים שיחקו בחצר עד הערב|היא כתבה מכתב ארוך לאחותה|לא מצאנו את המפתח של הבית|השוק הישן פתוח רק בבוקר|המורה שאל שאלה קשה|ירד גשם כל הלילה|הספר השני נעלם מהמדף|נסענו לים ביום שישי|אף אחד לא ענה לטלפון|העיר שקטה מאוד בלילה",
    "fa": "بچه‌ها در حیاط بازی می‌کردند|او نامه را در کشو گذاشت|باران تا صبح بارید|هیچ‌کس در را باز نکرد|ما کتاب را با هم خواندیم|بازار قدیمی شهر بسته بود|معلم پرسشی دشوار کرد|پرنده‌ها زود بیدار می‌شوند|برادرم به سفر رفته است|امروز هوا بسیار سرد است",
    "ur": "بچے صحن میں کھیل رہے ہیں|اس نے خط میز پر رکھ دیا|رات بھر بارش ہوتی رہی|کسی نے دروازہ نہیں کھولا|ہم نے کتاب مل کر پڑھی|پرانا بازار آج بند ہے|استاد نے مشکل سوال پوچھا|میرا بھائی سفر پر گیا ہے|شہر رات کو خاموش ہوتا ہے|مجھے جواب معلوم نہیں",
    "hi": "बच्चे आँगन में खेल रहे हैं|उसने चिट्ठी मेज़ पर रख दी|रात भर बारिश होती रही|किसी ने दरवाज़ा नहीं खोला|हमने किताब साथ में पढ़ी|पुराना बाज़ार आज बंद है|अध्यापक ने कठिन प्रश्न पूछा|मेरा भाई यात्रा पर गया है|शहर रात में शांत रहता है|मुझे उत्तर नहीं पता",
    "zh": "孩子们在院子里玩|她把信放在桌子上了|昨天晚上下了一夜的雨|没有人开门|我们一起读完了那本书|老市场今天关门了|老师问了一个很难的问题|我哥哥去旅行了|这座城市晚上很安静|我不知道答案|你吃饭了吗|我们去公园吧|他说好的|明天见|天气真好啊|请你把窗户打开吧|这本书是谁写的呢|我已经等了两个小时了|你为什么不早点告诉我呢|火车八点从北京出发|妈妈在厨房里做饭|他昨天买了一辆新车|我觉得这个办法不错|你们什么时候回来|别忘了带雨伞|商店里人很多|那个孩子哭了起来|我们下午开会|医生说他需要休息|花园里的花都开了",
    "ja": "子どもたちが庭で遊んでいます|彼女は手紙を机の上に置きました|昨日は一晩中雨が降りました|誰もドアを開けませんでした|私たちは一緒にその本を読みました|古い市場は今日閉まっています|先生は難しい質問をしました|兄は旅行に行きました|この町は夜とても静かです|答えは分かりません|もう食べましたか|公園へ行きましょう|明日また会いましょうね|いい天気ですね|窓を開けてください|この本は誰が書いたのですか|二時間も待っていました|どうして早く言わなかったの|電車は八時に出発します|母は台所で料理をしている|彼は新しい車を買った|その方法はいいと思う|いつ帰ってきますか|傘を忘れないでください|店の中は人でいっぱいだった|その子は泣き出した|午後に会議があります|医者は休むように言った|庭の花が全部咲いた|それは本当だ",
    "th": "เด็กๆเล่นอยู่ในสวน|เธอวางจดหมายไว้บนโต๊ะ|ฝนตกทั้งคืน|ไม่มีใครเปิดประตู|เราอ่านหนังสือด้วยกัน|ตลาดเก่าปิดวันนี้|ครูถามคำถามยาก|พี่ชายไปเที่ยวแล้ว|เมืองนี้เงียบมากตอนกลางคืน|ฉันไม่รู้คำตอบ|คุณกินข้าวหรือยัง|ไปสวนกันเถอะ|พรุ่งนี้เจอกันนะ|อากาศดีจริงๆ|ช่วยเปิดหน้าต่างหน่อยครับ|ใครเขียนหนังสือเล่มนี้|ฉันรอมาสองชั่วโมงแล้ว|ทำไมไม่บอกฉันก่อน|รถไฟออกแปดโมงเช้า|แม่ทำอาหารอยู่ในครัว",
}
#: End marks by language, the most common first.
ENDS = {"en": ". . . ? ! … ... ?! !!", "tr": ". . . ? ! … ...", "ar": ". . ؟ ! … ؟!", "he": ". . ? ! … ?!", "fa": ". . ؟ ! …", "ur": "۔ ۔ ۔ ؟ !", "hi": "। । ॥ ? !", "zh": "。 。 ！ ？ … ！！", "ja": "。 。 ！ ？ … ？！", "th": ""}
#: Abbreviations before a name, by language, and before a number.
TITLES = {"en": "Dr Prof Mr Mrs St vs e.g i.e al approx Sr Capt", "tr": "Dr Prof s bkz vd", "ar": "د أ ص ج ت م", "he": "פרופ עמ ד״ר גב מר", "fa": "د ص م", "ur": "", "hi": "डॉ प्रो श्री", "zh": "", "ja": "", "th": ""}
NUMBERED = {"en": "vol no pp p fig ca ch sec cf", "tr": "s no", "ar": "ص ج ت ق", "he": "עמ", "fa": "ص ج"}
#: Acronyms written with full stops, and words that begin a sentence behind one.
ACRONYMS = "U.S. U.K. U.N. D.C. Ph.D. p.m. a.m."
STARTERS = "The It He She They We I In But This That There Then My A No Yes When After".split()
#: Quotation marks by language.
QUOTES = {"en": "“” \"\"", "tr": "“” \"\" «»", "ar": "«» “” \"\"", "he": "\"\" “” «»", "fa": "«»", "ur": "“” «»", "hi": "“” \"\"", "zh": "“” 「」", "ja": "「」 『』"}
#: Clauses that report a quotation, behind it and before it.
BEHIND = {
    "en": "asked the reader|said my aunt|replied the guard|wrote the poet|answered he|asked Mary|said Dr. Grey",
    "tr": "diye sordu Ali|dedi annem|diye yazdı şair", "ar": "سأل القارئ|قال الرجل|أجابت البنت|صاح الحارس|قال سلقان", "he": "שאל הקורא|אמר האיש|השיב השומר|אמר דן",
    "fa": "پرسید مرد|گفت مادر", "ur": "", "hi": "", "zh": "", "ja": "",
}
BEFORE = {
    "en": "The guard said|My aunt wrote|He replied", "tr": "Annem dedi|Şair yazdı", "ar": "قال الرجل|كتبت المعلمة|سأل القارئ", "he": "האיש אמר|השומר השיב", "fa": "مرد گفت|او پرسید",
    "ur": "استاد نے کہا|اس نے لکھا", "hi": "उसने कहा|अध्यापक ने लिखा", "zh": "他说|老师问", "ja": "彼は言った|先生は書いた",
}
NAMES = {"en": "Aster Quill Marlow Grey Finch", "tr": "Aksoy Yılmaz Demir", "ar": "سلقان طروش مردين", "he": "כהן לוי ברק", "fa": "رضایی کاوه", "hi": "शर्मा वर्मा"}
SPACELESS = ("zh", "ja")


def _number(rng: random.Random, lang: str) -> str:
    text = rng.choice([f"{rng.randrange(1, 99)}.{rng.randrange(1, 99)}", f"{rng.randrange(1, 9)}.{rng.randrange(100, 999)}", str(rng.randrange(2, 400))])
    return text.translate(str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")) if lang in ("ar", "fa", "ur") and rng.random() < 0.4 else text


def _inside(rng: random.Random, lang: str, words: list[str]) -> list[str]:
    """Words with an abbreviation or a number put between them."""
    if len(words) < 2:
        return words
    at, kind = rng.randrange(1, len(words)), rng.random()
    if kind < 0.3 and TITLES.get(lang):
        title = rng.choice(TITLES[lang].split()) + "."
        if lang in ("en", "tr") and (title[0].islower() or rng.random() < 0.2):
            return [*words[:at], title, rng.choice([words[at].lower(), words[at].lower(), rng.choice(NAMES[lang].split())]), *words[at + 1 :]]
        return [*words[:at], title, rng.choice(NAMES[lang].split()), *words[at:]]
    if kind < 0.45 and NUMBERED.get(lang):
        piece = [rng.choice(NUMBERED[lang].split()) + ".", _number(rng, lang)]
        if rng.random() < 0.5:
            era = {"ar": " هـ"}.get(lang, "")
            piece = ["(" + " ".join(piece) + era + ")"]
        return [*words[:at], *piece, *words[at:]]
    if kind < 0.55 and lang == "en":
        return [*words[:at], rng.choice(ACRONYMS.split()), rng.choice(["Army", "Senate", "Museum", "officials", "and", "trade", "law", "Treasury"]), *words[at:]]
    if kind < 0.62 and lang in ("en", "tr"):
        return [*words[:at], rng.choice(["...", "…"]), words[at].lower(), *words[at + 1 :]]
    if kind < 0.7 and lang in ("en", "tr"):  # an abbreviation no list has, before a small letter
        return [*words[:at], "".join(rng.choice("bcdfglmnprst") for _ in range(rng.randrange(2, 5))) + ".", words[at].lower(), *words[at + 1 :]]
    if kind < 0.8 and kind > 0.74:  # a file or an address
        return [*words[:at], rng.choice(["basis", "notes", "table", "index", "page"]) + rng.choice(["", "_7", "_12", "2"]) + rng.choice([".json", ".txt", ".org", ".pdf", ".py"]), *words[at:]]
    if kind < 0.74 and lang in ("en", "tr"):  # a mark that ends no sentence before a small letter
        return [*words[:at], words[at - 1] + rng.choice("!?"), words[at].lower(), *words[at + 1 :]]
    return [*words[:at], _number(rng, lang), *words[at:]]


def sentence(rng: random.Random, lang: str) -> str:
    """One sentence with its end mark."""
    joint = "" if lang in SPACELESS else " "
    plain = lambda: rng.choice(SENTENCES[lang].split("|"))
    mark = lambda: rng.choice(ENDS[lang].split())
    body, kind = plain(), rng.random()
    if lang == "en" and kind < 0.06:
        return f"{body} in the {rng.choice(ACRONYMS.split())}"
    if kind < 0.35:
        words = list(body) if lang in SPACELESS else body.split(" ")
        body = joint.join(_inside(rng, lang, words))
    elif kind < 0.62 and QUOTES.get(lang):
        opener, closer = rng.choice(QUOTES[lang].split())
        inner = plain() + mark()
        while rng.random() < 0.3:
            inner += joint + plain() + mark()
        style = rng.random()
        if style < 0.35 and BEHIND.get(lang):
            return f"{opener}{inner}{closer} {rng.choice(BEHIND[lang].split('|'))}{rng.choice('.!') if lang != 'ur' else '۔'}"
        if style < 0.8:
            comma = "：" if lang in SPACELESS else rng.choice([": ", " : "]) if rng.random() < 0.1 else ": "
            return f"{rng.choice(BEFORE[lang].split('|'))}{comma}{opener}{inner}{closer}"
        return f"{opener}{inner}{closer}"
    elif kind < 0.68 and QUOTES.get(lang):  # quoted words, the mark behind the quotation
        opener, closer = rng.choice(QUOTES[lang].split())
        words = list(body) if lang in SPACELESS else body.split(" ")
        words[-1] = opener + words[-1] + closer
        body = joint.join(words)
    elif kind < 0.72 and lang not in SPACELESS:
        body = f"{body} ({plain().lower() if lang == 'en' else plain()})"
    return body + mark()


def text(rng: random.Random, lang: str, size: int = 9, whole: bool = False) -> tuple[str, list[int]]:
    """(text, ends of its sentences) of one language."""
    out, ends = "", []
    if lang == "th":
        for _ in range(size):
            body = rng.choice(SENTENCES["th"].split("|"))
            if rng.random() < 0.3:
                at = rng.randrange(3, len(body) - 6)
                while at < len(body) - 1 and (body[at] in "ะาำๅๆ็่้๊๋์" or "ั" <= body[at] <= "ฺ" or "เ" <= body[at - 1] <= "ไ"):
                    at += 1
                body = f"{body[:at]} {_number(rng, 'th')} {body[at:]}".strip()
            out += (" " if out else "") + body
            ends.append(len(out))
        return out, ends
    before = ""
    for _ in range(size):
        if out and rng.random() < 0.06:
            out += "\n\n" + rng.choice(SENTENCES[lang].split("|"))  # a heading
            ends.append(len(out))
            before = "\n\n"
        now = sentence(rng, lang)
        if out.rstrip().endswith(tuple(ACRONYMS.split())) and before != "\n\n":
            now = f"{rng.choice(STARTERS)} {now[0].lower()}{now[1:]}" if now[0].isalpha() else now
        gap = "" if lang in SPACELESS and rng.random() < 0.9 else rng.choices([" ", "", "\n", "\n\n"], [72, 14, 8, 6])[0]
        if gap == "" and (now[0].isdigit() or now[0] in "\"“«"):
            gap = " " if lang not in SPACELESS else gap
        out += ((before or gap) if out else "") + now
        ends.append(len(out))
        before = ""
    if not whole and rng.random() < 0.15:  # cut off
        cut = rng.choice(SENTENCES[lang].split("|"))
        out += ("" if lang in SPACELESS else " ") + cut[: max(2, len(cut) // 2)].rstrip()
        ends.append(len(out))
    return out, ends


def texts(number: int, seed: int) -> list[tuple[str, list[int]]]:
    """Seeded texts of all languages in turn; some hold a stretch of another language."""
    rng = random.Random(seed)
    out = []
    for k in range(number):
        langs = list(SENTENCES)
        lang = langs[k % len(langs)]
        mixed = rng.random() < 0.2 and lang != "th"
        body, ends = text(rng, lang, whole=mixed)
        if mixed:
            other = rng.choice([x for x in langs if x not in (lang, "th")])
            more, more_ends = text(rng, other, 2)
            ends += [len(body) + 1 + e for e in more_ends]
            body += " " + more
        out.append((body, ends))
    return out


def bare(number: int, seed: int, held: bool = False) -> list[list[str]]:
    """Sequences of sentences of scripts without spaces, for texts without marks; every fifth sentence is held out of training."""
    rng = random.Random(seed)
    out = []
    for k in range(number):
        listed = [s for n, s in enumerate(SENTENCES[("zh", "ja", "th")[k % 3]].split("|")) if (n % 5 == 4) == held]
        out.append([rng.choice(listed) for _ in range(rng.randrange(3, 8))])
    return out
