"""Named character sets: ordered strings of distinct characters, by script and language.

Scripts have their parts as fixed values or, where the set is a block of the Unicode database, a rule; languages add and
remove letters. Japanese has the kanji of its standard's first level. ``registry`` takes a parameter for sets that should be other.
"""

from __future__ import annotations

import string
import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of scripts: the letters, marks and digits of each. The scripts' own characters.
PARTS = {
    "bengali_consonants": "কখগঘঙচছজঝঞটঠডঢণতথদধনপফবভমযরলশষসহড়ঢ়য়ৰৱৼ",
    "bengali_vowels": "অআইঈউঊঋঌএঐওঔৠৡ",
    "bengali_digits": "০১২৩৪৫৬৭৮৯",
    "bengali_matras": "ািীুূৃেৈোৌৗ",
    "bengali_virama": "্",
    "bengali_punctuation": "ঽৎ৽৺৻",
    "bengali_signs": "ঁংঃ়",
    "gujarati_consonants": "કખગઘઙચછજઝઞટઠડઢણતથદધનપફબભમયરલળવશષસહ",
    "gujarati_vowels": "અઆઇઈઉઊઋઌઍએઐઑઓઔ",
    "gujarati_digits": "૦૧૨૩૪૫૬૭૮૯",
    "gujarati_matras": "ઁંઃ઼ાિીુૂૃૄૅેૈૉોૌૢૣૺૻૼ૽૾૿",
    "gujarati_virama": "્",
    "gujarati_punctuation": "ઽ॥",
    "gujarati_signs": "ૐ૰",
    "devanagari_consonants": "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहऴऩळक़ख़ग़ज़ड़ढ़फ़य़ऱॺॻॼॽॾ",
    "devanagari_vowels": "अआइईउऊऋऌऍऎएऐऑऒओऔॠॡॲऄॵॶॳॴॷॸॹ",
    "devanagari_digits": "०१२३४५६७८९",
    "devanagari_matras": "़ंँः॒॑ािीुूृॄॅॆेैॉॊोौॢॣॏॎ",
    "devanagari_virama": "्",
    "devanagari_punctuation": "।॥॰ऽꣲ",
    "devanagari_signs": "ॐ",
    "punjabi_consonants": "ਕਖਗਘਙਚਛਜਝਞਟਠਡਢਣਤਥਦਧਨਪਫਬਭਮਯਰਲਵਸ਼ਸਹਖ਼ਗ਼ਜ਼ਫ਼ੜਲ਼",
    "punjabi_vowels": "ਅਆਇਈਉਊਏਐਓਔੲੳ",
    "punjabi_digits": "੦੧੨੩੪੫੬੭੮੯",
    "punjabi_matras": "ਂ਼ਾਿੀੁੂੇੈੋੌੑੰੱੵ",
    "punjabi_virama": "੍",
    "punjabi_punctuation": "।॥",
    "punjabi_signs": "ੴ",
    "tamil_consonants": "கஙசஞடணதநபமயரலவழளறன",
    "tamil_vowels": "அஆஇஈஉஊஎஏஐஒஓஔ",
    "tamil_digits": "௦௧௨௩௪௫௬௭௮௯",
    "tamil_matras": "ாிீுூெேைொோௌ",
    "tamil_virama": "்",
    "tamil_punctuation": "௰௱௲",
    "tamil_signs": "ஃௐ",
    "tamil_fractions": "௳௴௵௶௷௸௹௺",
    "telugu_consonants": "కఖగఘఙచఛజఝఞటఠడఢణతథదధనపఫబభమయరఱలళవశషసహఴ",
    "telugu_digits": "౦౧౨౩౪౫౬౭౮౯౸౹౺౻",
    "telugu_vowels": "అఆఇఈఉఊఋఌఎఏఐఒఓఔౠౡ",
    "telugu_matras": "ాిీుూృౄెేైొోౌౢౣ",
    "telugu_virama": "్",
    "telugu_punctuation": "ఽ",
    "telugu_signs": "ఁంః",
    "kannada_consonants": "ಕಖಗಘಙಚಛಜಝಞಟಠಡಢಣತಥದಧನಪಫಬಭಮಯರಲವಶಷಸಹಳ",
    "kannada_vowels": "ಅಆಇಈಉಊಋॠಌೡಎಏಐಒಓಔ",
    "kannada_digits": "೦೧೨೩೪೫೬೭೮೯",
    "kannada_matras": "ಾಿೀುೂೃೄೆೇೈೊೋೌ",
    "kannada_virama": "್",
    "kannada_punctuation": "।॥ೱೲ",
    "kannada_signs": "ಂಃಁ",
    "sinhala_consonants": "කඛගඝඞචඡජඣඤටඨඩඪණතථදධනපඵබභමයරලවශෂසහළෆ",
    "sinhala_vowels": "අආඇඈඉඊඋඌඍඎඏඐඑඒඓඔඕඖ",
    "sinhala_digits": "෦෧෨෩෪෫෬෭෮෯",
    "sinhala_matras": "ාැෑිීුූෙේෛොෝෞ",
    "sinhala_virama": "්",
    "sinhala_punctuation": "෴",
    "sinhala_signs": "ංඃ",
    "malayalam_consonants": "കഖഗഘങചഛജഝഞടഠഡഢണതഥദധനപഫബഭമയരറലളഴവശഷസഹ",
    "malayalam_vowels": "അആഇഈഉഊഋൠഌൡഎഏഐഒഓഔ",
    "malayalam_digits": "൦൧൨൩൪൫൬൭൮൯",
    "malayalam_matras": "ാിീുൂൃൄൢൣെേൈൊോൌ",
    "malayalam_virama": "്",
    "malayalam_signs": "ഃ൹ഽ൏ം",
    "odia_consonants": "କଖଗଘଙଚଛଜଝଞଟଠଡଢଣତଥଦଧନପଫବଭମଯରଲଳଵଶଷସହୟୱଡ଼ଢ଼",
    "odia_vowels": "ଅଆଇଈଉଊଋଌଏଐଓଔୡୠ",
    "odia_digits": "୦୧୨୩୪୫୬୭୮୯୲୳୴୵୶୷",
    "odia_matras": "ାିୀୁୂୃୄେୈୋୌୢୣ",
    "odia_virama": "୍",
    "odia_punctuation": "ଽ",
    "odia_signs": "ଂଃଁ଼୰",
    "khmer_consonants": "កខគឃងចឆជឈញដឋឌឍណតថទធនបផពភមយរលវឝឞសហឡអ",
    "khmer_vowels": "ឣឤឥឦឧឨឩឪឫឬឭឮឯឰឱឲឳ",
    "khmer_digits": "០១២៣៤៥៦៧៨៩",
    "khmer_matras": "ាិីឹឺុូួើឿៀេែៃោៅ",
    "khmer_diacritics": "ំះៈ៉៊់៌៍៎៏័៑៓៝",
    "khmer_virama": "្",
    "khmer_punctuation": "។៕៖៘៙៚ៗៜ",
    "burmese_consonants": "ကခဂဃငစဆဇဈဉညဋဌဍဎဏတထဒဓနပဖဗဘမယရလဝသဟဠအၐၑၒၓၔၕၚၛၜၝၡၥၦၮၯၰၵၶၷၸၹၺၻၼၽၾၿႀႁႎ",
    "burmese_vowels": "ဣဤဥဦဧဩဪဿ",
    "burmese_digits": "၀၁၂၃၄၅၆၇၈၉႐႑႒႓႔႕႖႗႘႙",
    "burmese_diacritics": "့းံါာိီုူေဲဳဴဵျြွှ",
    "burmese_virama": "္်",
    "burmese_punctuation": "၊။၌၍၎၏ၤၗ",
    "javanese_consonants": "ꦏꦐꦑꦒꦓꦔꦕꦖꦗꦘꦙꦚꦛꦜꦝꦞꦟꦠꦡꦢꦣꦤꦥꦦꦧꦨꦩꦪꦫꦬꦭꦮꦯꦰꦱꦲ",
    "javanese_vowels": "ꦄꦅꦆꦇꦈꦉꦊꦋꦌꦍꦎꦴꦵꦶꦷꦸꦹꦺꦻꦼ",
    "javanese_digits": "꧐꧑꧒꧓꧔꧕꧖꧗꧘꧙",
    "javanese_diacritics": "ꦀꦁꦂꦃ꦳ꦽꦾꦿ",
    "javanese_virama": "꧀",
    "javanese_punctuation": "꧈꧉꧊꧋꧌꧍ꧏ",
    "sudanese_consonants": "ᮊᮋᮌᮍᮎᮏᮐᮑᮒᮓᮔᮕᮖᮗᮘᮙᮚᮛᮜᮝᮞᮟᮠᮮᮯᮺᮻᮼᮽᮾᮿ",
    "sudanese_vowels": "ᮃᮄᮅᮆᮇᮈᮉ",
    "sudanese_digits": "᮰᮱᮲᮳᮴᮵᮶᮷᮸᮹",
    "sudanese_diacritics": "ᮀᮁᮂᮡᮢᮣᮤᮥᮦᮧᮨᮩ᮪᮫ᮬᮭ",
    "hebrew_cantillations": "֑֖֛֢֣֤֥֦֧֪֚֭֮֒֓֔֕֗֘֙֜֝֞֟֠֡֨֩֫֬֯",
    "hebrew_consonants": "אבגדהוזחטיךכלםמןנסעףפץצקרשת",
    "hebrew_punctuation": "ֽ־ֿ׀ׁׂ׃ׅׄ׆׳״",
    "hebrew_vowels": "ְֱֲֳִֵֶַָׇֹֺֻ",
    "arabic_diacritics": "ًٌٍَُِّْٕٓٔٚ",
}

#: What a script's whole set is made of, in order: its parts, ``ascii`` (the Western punctuation) or ``latin_digits``, and its currency sign.
SCRIPTS = {
    "devanagari": ("consonants vowels digits matras virama punctuation ascii", "₹"),
    "gujarati": ("consonants vowels digits matras virama punctuation ascii signs", "૱"),
    "bengali": ("consonants vowels digits matras virama punctuation ascii signs", "৳"),
    "tamil": ("consonants vowels digits matras virama punctuation ascii fractions signs", "₹"),
    "telugu": ("consonants vowels digits matras virama punctuation ascii signs", "₹"),
    "kannada": ("consonants vowels digits matras virama punctuation ascii signs", "₹"),
    "sinhala": ("consonants vowels digits matras virama punctuation ascii signs", "₹"),
    "malayalam": ("consonants vowels digits matras virama ascii signs", "₹"),
    "punjabi": ("consonants vowels digits matras virama punctuation ascii signs", "₹"),
    "odia": ("consonants vowels digits matras virama punctuation ascii signs", "₹"),
    "khmer": ("consonants vowels digits matras virama diacritics punctuation ascii", "៛"),
    "sudanese": ("latin_digits digits consonants vowels diacritics ascii", ""),
    "burmese": ("latin_digits digits consonants vowels diacritics virama punctuation", ""),
    "javanese": ("latin_digits digits consonants vowels diacritics virama punctuation ascii", ""),
}

#: Latin alphabets: letters that a language does without and letters it adds. The languages' alphabets.
LATIN = {
    "albanian": ("", "çëÇË"), "afrikaans": ("", "èëïîôûêÈËÏÎÔÛÊ"), "azerbaijani": ("Ww", "çəğöşüÇƏĞÖŞÜ₼"), "basque": ("", "ñçÑÇ"),
    "bosnian": ("QqWwXxYy", "čćđšžČĆĐŠŽ"), "catalan": ("", "àèéíïòóúüçÀÈÉÍÏÒÓÚÜÇ"), "croatian": ("", "ČčĆćĐđŠšŽž"),
    "czech": ("", "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"), "danish": ("", "æøåÆØÅ"), "dutch": ("", "áéíóúüñÁÉÍÓÚÜÑ"), "estonian": ("", "šžõäöüŠŽÕÄÖÜ"),
    "esperanto": ("QqWwXxYy", "ĉĝĥĵŝŭĈĜĤĴŜŬ₷"), "french": ("", "àâéèêëîïôùûüçÀÂÉÈÊËÎÏÔÙÛÜÇ"), "finnish": ("", "äöÄÖ"), "frisian": ("QqXx", "âêôûúÂÊÔÛÚƒƑ"),
    "galician": ("JjKkWw", "ñÑçÇ"), "german": ("", "äöüßÄÖÜẞ"), "hausa": ("PpQqVvXx", "ɓɗƙƴƁƊƘƳ₦"), "hungarian": ("", "áéíóöúüÁÉÍÓÖÚÜ"),
    "icelandic": ("CcQqWw", "ðáéíóúýþæöÐÁÉÍÓÚÝÞÆÖ"), "indonesian": ("", ""), "irish": ("", "áéíóúÁÉÍÓÚ"), "italian": ("", "àèéìíîòóùúÀÈÉÌÍÎÒÓÙÚ"),
    "latvian": ("QqWwXx", "āčēģīķļņšūžĀČĒĢĪĶĻŅŠŪŽ"), "lithuanian": ("QqWwXx", "ąčęėįšųūžĄČĘĖĮŠŲŪŽ"), "luxembourgish": ("", "äöüéëÄÖÜÉË"),
    "maori": ("BbCcDdFfJjLlOoQqSsVvXxYyZz", "āēīōūĀĒĪŌŪ"), "malagasy": ("CcQqUuWwXx", "ôñÔÑ"), "malay": ("", ""), "maltese": ("CcYy", "ċġħżĊĠĦŻ"),
    "montenegrin": ("QqWwXxYy", "čćšžźČĆŠŚŽŹ"), "norwegian": ("", "æøåÆØÅ"), "polish": ("", "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"),
    "portuguese": ("", "áàâãéêíïóôõúüçÁÀÂÃÉÊÍÏÓÔÕÚÜÇ"), "quechua": ("BbDdFfGgJjVvXxZz", "ñÑĉĈçÇ"), "romanian": ("", "ăâîșțĂÂÎȘȚ"),
    "scottish_gaelic": ("JjKkQqVvWwXxYyZz", "àèìòùÀÈÌÒÙ"), "serbian_latin": ("", "čćđžšČĆĐŽŠ"), "slovak": ("", "ôäčďľňšťžáéíĺóŕúýÔÄČĎĽŇŠŤŽÁÉÍĹÓŔÚÝ"),
    "slovene": ("QqWwXxYy", "čćđšžČĆĐŠŽ"), "somali": ("PpVvZz", ""), "spanish": ("", "áéíóúüñÁÉÍÓÚÜÑ¡¿"), "swahili": ("QqXx", ""), "swedish": ("", "åäöÅÄÖ"),
    "tagalog": ("CcQqWwXx", "ñÑ₱"), "turkish": ("QqWwXx", "çğıöşüâîûÇĞİÖŞÜÂÎÛ₺"), "uzbek_latin": ("Ww", "çğɉñöşÇĞɈÑÖŞ"),
    "vietnamese": ("", "áàảạãăắằẳẵặâấầẩẫậđéèẻẽẹêếềểễệóòỏõọôốồổộỗơớờởợỡúùủũụưứừửữựíìỉĩịýỳỷỹỵÁÀẢẠÃĂẮẰẲẴẶÂẤẦẨẪẬĐÉÈẺẼẸÊẾỀỂỄỆÓÒỎÕỌÔỐỒỔỘỖƠỚỜỞỢỠÚÙỦŨỤƯỨỪỬỮỰÍÌỈĨỊÝỲỶỸỴ₫"),
    "welsh": ("KkQqVvXxZz", "âêîôŵŷÂÊÎÔŴŶ"), "yoruba": ("CcQqVvXxZz", "ẹọṣẸỌṢ₦"), "zulu": ("", ""),
}

#: The letters that all Cyrillic alphabets here share.
GENERIC_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщьюяАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЬЮЯ"
#: Cyrillic alphabets: whether they have the Russian letters and signs, and what they add. The languages' alphabets.
CYRILLIC = {
    "russian": (True, True, "₽"), "belarusian": (True, False, "ўiЎI₽"), "ukrainian": (False, False, "ґіїєҐІЇЄ₴"), "tatar": (True, True, "₽ӘәҖҗҢңӨөҮү"),
    "tajik": (True, True, "ҒғҚқҲҳҶҷӢӣӮӯ"), "kazakh": (True, True, "ӘәҒғҚқҢңӨөҰұҮүҺһІі₸"), "kyrgyz": (True, True, "ҢңӨөҮү"), "bulgarian": (False, True, ""),
    "macedonian": (False, False, "ЃѓЅѕЈјЉљЊњЌќЏџ"), "mongolian": (True, True, "ӨөҮү᠐᠑᠒᠓᠔᠕᠖᠗᠘᠙₮"), "yakut": (True, True, "ҔҕҤҥӨөҺһҮү₽"), "uzbek_cyrillic": (True, True, "ЎўҚқҒғҲҳ"),
}
#: Arabic alphabets after the Arabic and Persian letters. The languages' alphabets.
ARABIC = {"persian": "", "urdu": "ٹڈڑںھےہۃ", "pashto": "ټډړږښځڅڼېۍ", "kurdish": "ڵڕۆێە", "uyghur": "ەېۆۇۈڭھ", "sindhi": "ڀٿٺٽڦڄڃڇڏڌڊڍڙڳڱڻھ"}
#: Punctuation of the East Asian sets.
EAST_ASIAN = "。・〜°—、「」『』【】゛》《〉〈"
#: The sets that ``multilingual`` joins, in order; the paragraph sign stands between the Latin and the others.
MULTILINGUAL = ("english", *LATIN, *(n for n in CYRILLIC if n != "uzbek_cyrillic"), "serbian_cyrillic", "uzbek_cyrillic", "greek", "hebrew")


def distinct(text: str) -> str:
    """Each character once, at its first place."""
    return "".join(dict.fromkeys(text))


def without(text: str, letters: str) -> str:
    return "".join(c for c in text if c not in letters)


def characters(a: int, b: int) -> list[tuple[str, str, str]]:
    """Assigned characters between two code points with their names and categories."""
    found = (chr(p) for p in range(a, b + 1))
    return [(c, unicodedata.name(c, ""), unicodedata.category(c)) for c in found if unicodedata.name(c, "")]


def standard_rows(codec: str, first: int, last: int) -> str:
    """The characters of the rows of a 94 by 94 national standard, in its order."""
    out = []
    for row in range(first, last + 1):
        for cell in range(1, 95):
            try:
                out.append(bytes([0xA0 + row, 0xA0 + cell]).decode(codec))
            except UnicodeDecodeError:
                continue
    return "".join(out)


def span(*ranges: tuple[int, int]) -> str:
    """The assigned characters of ranges of code points."""
    return "".join(c for a, b in ranges for c, _, _ in characters(a, b))


def joined(sets: dict[str, str]) -> str:
    """The sets of MULTILINGUAL one after another, with the paragraph sign after the Latin ones."""
    return "".join(sets[n] + "§" * (n == tuple(LATIN)[-1]) for n in MULTILINGUAL)


def registry(given: dict[str, str] | None = None) -> dict[str, str]:
    """All sets by name. ``given`` replaces sets, and adds others; what is derived from a replaced base set follows it."""
    given = given or {}
    out: dict[str, str] = {}

    def put(name: str, value: str) -> None:
        out[name] = distinct(given.get(name, value))

    put("digits", string.digits)
    put("ascii_letters", string.ascii_letters)
    put("punctuation", string.punctuation)
    put("currency", "£€¥¢฿")
    put("generic_cyrillic_letters", GENERIC_CYRILLIC)
    put("russian_cyrillic_letters", "ёыэЁЫЭ")
    put("russian_signs", "ъЪ")
    put("ancient_greek", "αβγδεζηθικλμνξοπρστςυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
    put("arabic_digits", span((0x660, 0x669)))
    put("arabic_letters", span((0x621, 0x63A), (0x640, 0x64A), (0x671, 0x671)))
    put("arabic_punctuation", "؟؛«»—،")
    put("persian_letters", "پچژڢڤگکی")
    put("hebrew_specials", span((0x5EF, 0x5F2), (0xFB1D, 0xFB4F)))
    for name, value in PARTS.items():
        put(name, value)
    marks = out["digits"] + out["punctuation"]
    put("latin", out["digits"] + out["ascii_letters"] + out["punctuation"])
    put("english", out["latin"] + "°" + out["currency"])
    for name, (less, more) in LATIN.items():
        put(name, without(out["english"], less) + more)
    for name, (letters, signs, more) in CYRILLIC.items():
        put(name, out["generic_cyrillic_letters"] + out["russian_cyrillic_letters"] * letters + out["russian_signs"] * signs + marks + out["currency"] + more)
    put("serbian_cyrillic", without(GENERIC_CYRILLIC, "йщьюяЙЩЬЮЯ") + "JjЂђЉљЊњЋћЏџ" + marks + out["currency"])
    put("greek", out["punctuation"] + out["ancient_greek"] + out["currency"] + "άέήίϊΐόύϋΰώΆΈΉΊΪΌΎΫΏ")
    put("greek_extended", out["greek"] + "ͶͷϜϝ" + "".join(c for c, n, k in characters(0x1F00, 0x1FFF) if k in ("Lu", "Ll", "Lt") and not n.endswith(("WITH VRACHY", "WITH MACRON", "WITH OXIA", "GREEK PROSGEGRAMMENI"))))
    put("hebrew", marks + "".join(out[f"hebrew_{p}"] for p in ("consonants", "vowels", "punctuation", "cantillations", "specials")) + "₪")
    put("arabic", out["digits"] + "".join(out[n] for n in ("arabic_digits", "arabic_letters", "persian_letters", "arabic_diacritics", "arabic_punctuation")) + out["punctuation"])
    for name, more in ARABIC.items():
        put(name, out["arabic"] + more)
    given_parts = {"ascii": out["punctuation"], "latin_digits": out["digits"]}
    for script, (parts, currency) in SCRIPTS.items():
        put(script, "".join(given_parts[p] if p in given_parts else out[f"{script}_{p}"] for p in parts.split()) + currency)
    for name in ("hindi", "sanskrit", "marathi", "nepali"):
        put(name, out["devanagari"])
    put("armenian", span((0x531, 0x556), (0x559, 0x559), (0x560, 0x588)) + marks + span((0x55A, 0x55F), (0x589, 0x58A), (0x58F, 0x58F)))
    thai = "๏๚๛ๆฯ" + span((0xE01, 0xE2E)) + "ะาำเแโใไๅ" + span((0xE31, 0xE31), (0xE34, 0xE3A), (0xE47, 0xE4E)) + "฿"
    put("thai", out["digits"] + span((0xE50, 0xE59)) + out["punctuation"] + thai)
    lao = "ໆໞໟຯ" + span((0xE81, 0xEAE)) + "ະາຳຽເແໂໃໄໜໝ" + span((0xEB1, 0xEB1), (0xEB4, 0xEBC), (0xEC8, 0xECD))
    put("lao", out["digits"] + span((0xED0, 0xED9)) + out["punctuation"] + lao)
    put("georgian", out["digits"] + span((0x10A0, 0x10FA), (0x10FC, 0x10FF)) + out["punctuation"] + "჻₾")
    put("ethiopic", span((0x1200, 0x135A), (0x1380, 0x138F), (0x1369, 0x137C)))
    ending = out["punctuation"] + EAST_ASIAN + out["currency"]
    kana = span((0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF))
    put("japanese", out["digits"] + kana + standard_rows("euc_jp", 16, 47) + ending)
    put("korean", out["digits"] + "".join(map(chr, range(0xAC00, 0xD7A4))) + ending + "₩")
    put("simplified_chinese", out["digits"] + "".join(map(chr, range(0x3400, 0x4DC0))) + ending)
    put("multilingual", joined(out))
    for name, value in given.items():
        out[name] = distinct(value)
    return out


def table(spark: SparkSession, sets: dict[str, str] | None = None) -> DataFrame:
    """The registry as rows of ``name``, ``pos`` (from 0) and ``ch``."""
    rows = spark.createDataFrame(sorted((sets or registry()).items()), "name string, chars string")
    return rows.select("name", F.posexplode(F.split("chars", "")).alias("pos", "ch")).where("ch <> ''")


def duplicates(rows: DataFrame) -> DataFrame:
    """Characters that a set has more than once."""
    return rows.groupBy("name", "ch").agg(F.count("*").alias("n")).where("n > 1")
