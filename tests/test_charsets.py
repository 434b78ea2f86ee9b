"""The character sets against code points, which are written down independently of the registry."""

from collections import Counter

import pytest

from glyphloom.functions import charsets

SETS = charsets.registry()
#: First and last code points of the parts of scripts, in order. Fixed values.
RANGES = """
bengali_consonants 995-9A8 9AA-9B0 9B2 9B6-9B9 9DC-9DD 9DF 9F0-9F1 9FC
bengali_vowels 985-98C 98F-990 993-994 9E0-9E1
bengali_digits 9E6-9EF
bengali_matras 9BE-9C3 9C7-9C8 9CB-9CC 9D7
bengali_virama 9CD
bengali_punctuation 9BD 9CE 9FD 9FA-9FB
bengali_signs 981-983 9BC
gujarati_consonants A95-AA8 AAA-AB0 AB2-AB3 AB5-AB9
gujarati_vowels A85-A8D A8F-A91 A93-A94
gujarati_digits AE6-AEF
gujarati_matras A81-A83 ABC ABE-AC5 AC7-AC9 ACB-ACC AE2-AE3 AFA-AFF
gujarati_virama ACD
gujarati_punctuation ABD 965
gujarati_signs AD0 AF0
devanagari_consonants 915-928 92A-930 932 935-939 934 929 933 958-95F 931 97A-97C 97D-97E
devanagari_vowels 905-914 960-961 972 904 975-976 973-974 977-979
devanagari_digits 966-96F
devanagari_matras 93C 902 901 903 951-952 93E-94C 962-963 94F 94E
devanagari_virama 94D
devanagari_punctuation 964-965 970 93D A8F2
devanagari_signs 950
punjabi_consonants A15-A28 A2A-A30 A32 A35-A36 A38-A39 A59-A5B A5E A5C A33
punjabi_vowels A05-A0A A0F-A10 A13-A14 A72-A73
punjabi_digits A66-A6F
punjabi_matras A02 A3C A3E-A42 A47-A48 A4B-A4C A51 A70-A71 A75
punjabi_virama A4D
punjabi_punctuation 964-965
punjabi_signs A74
tamil_consonants B95 B99-B9A B9E-B9F BA3-BA4 BA8 BAA BAE-BB0 BB2 BB5 BB4 BB3 BB1 BA9
tamil_vowels B85-B8A B8E-B90 B92-B94
tamil_digits BE6-BEF
tamil_matras BBE-BC2 BC6-BC8 BCA-BCC
tamil_virama BCD
tamil_punctuation BF0-BF2
tamil_signs B83 BD0
tamil_fractions BF3-BFA
telugu_consonants C15-C28 C2A-C33 C35-C39 C34
telugu_digits C66-C6F C78-C7B
telugu_vowels C05-C0C C0E-C10 C12-C14 C60-C61
telugu_matras C3E-C44 C46-C48 C4A-C4C C62-C63
telugu_virama C4D
telugu_punctuation C3D
telugu_signs C01-C03
kannada_consonants C95-CA8 CAA-CB0 CB2 CB5-CB9 CB3
kannada_vowels C85-C8B 960 C8C CE1 C8E-C90 C92-C94
kannada_digits CE6-CEF
kannada_matras CBE-CC4 CC6-CC8 CCA-CCC
kannada_virama CCD
kannada_punctuation 964-965 CF1-CF2
kannada_signs C82-C83 C81
sinhala_consonants D9A-D9E DA0-DA4 DA7-DAB DAD-DB1 DB4-DB8 DBA-DBB DBD DC0-DC6
sinhala_vowels D85-D96
sinhala_digits DE6-DEF
sinhala_matras DCF-DD4 DD6 DD9-DDE
sinhala_virama DCA
sinhala_punctuation DF4
sinhala_signs D82-D83
malayalam_consonants D15-D28 D2A-D39
malayalam_vowels D05-D0B D60 D0C D61 D0E-D10 D12-D14
malayalam_digits D66-D6F
malayalam_matras D3E-D44 D62-D63 D46-D48 D4A-D4C
malayalam_virama D4D
malayalam_signs D03 D79 D3D D4F D02
odia_consonants B15-B28 B2A-B30 B32-B33 B35-B39 B5F B71 B5C-B5D
odia_vowels B05-B0C B0F-B10 B13-B14 B61 B60
odia_digits B66-B6F B72-B77
odia_matras B3E-B44 B47-B48 B4B-B4C B62-B63
odia_virama B4D
odia_punctuation B3D
odia_signs B02-B03 B01 B3C B70
khmer_consonants 1780-17A2
khmer_vowels 17A3-17B3
khmer_digits 17E0-17E9
khmer_matras 17B6-17C5
khmer_diacritics 17C6-17D1 17D3 17DD
khmer_virama 17D2
khmer_punctuation 17D4-17D6 17D8-17DA 17D7 17DC
burmese_consonants 1000-1021 1050-1055 105A-105D 1061 1065-1066 106E-1070 1075-1081 108E
burmese_vowels 1023-1027 1029-102A 103F
burmese_digits 1040-1049 1090-1099
burmese_diacritics 1037-1038 1036 102B-1035 103B-103E
burmese_virama 1039-103A
burmese_punctuation 104A-104F 1064 1057
javanese_consonants A98F-A9B2
javanese_vowels A984-A98E A9B4-A9BC
javanese_digits A9D0-A9D9
javanese_diacritics A980-A983 A9B3 A9BD-A9BF
javanese_virama A9C0
javanese_punctuation A9C8-A9CD A9CF
sudanese_consonants 1B8A-1BA0 1BAE-1BAF 1BBA-1BBF
sudanese_vowels 1B83-1B89
sudanese_digits 1BB0-1BB9
sudanese_diacritics 1B80-1B82 1BA1-1BAD
hebrew_cantillations 591-5AF
hebrew_consonants 5D0-5EA
hebrew_punctuation 5BD-5C6 5F3-5F4
hebrew_vowels 5B0-5BB 5C7
arabic_diacritics 64B-652 655 653-654 65A
"""
#: Characters in the sets of whole scripts and languages that are not made of parts alone. Fixed values.
SIZES = {
    "digits": 10, "ascii_letters": 52, "punctuation": 32, "latin": 94, "english": 100, "german": 108, "french": 126, "maori": 84, "vietnamese": 235,
    "russian": 114, "serbian_cyrillic": 107, "greek": 106, "arabic": 116, "korean": 11_237, "simplified_chinese": 6_656, "thai": 129, "georgian": 131,
}


def expanded(spec):
    ends = [(r.partition("-")[0], r.partition("-")[2] or r) for r in spec.split()]
    return "".join(chr(p) for a, b in ends for p in range(int(a, 16), int(b, 16) + 1))


@pytest.mark.parametrize("line", RANGES.strip().splitlines())
def test_parts(line):
    name, spec = line.split(" ", 1)
    assert SETS[name] == expanded(spec)


@pytest.mark.parametrize("name", sorted(SETS))
def test_no_duplicates(name):
    assert SETS[name] and not [c for c, n in Counter(SETS[name]).items() if n > 1]


@pytest.mark.parametrize("name", sorted(SIZES))
def test_sizes(name):
    assert len(SETS[name]) == SIZES[name]


def test_orders():
    assert SETS["ancient_greek"][:25] == "αβγδεζηθικλμνξοπρστςυφχψω"
    assert SETS["tamil"].endswith(expanded("BF3-BFA B83 BD0") + "₹") and SETS["khmer"].endswith(SETS["punctuation"] + "៛")
    assert SETS["thai"][52:] == expanded("E4F E5A-E5B E46 E2F E01-E2E E30 E32-E33 E40-E45 E31 E34-E3A E47-E4E E3F")
    assert SETS["lao"][52:] == expanded("EC6 EDE-EDF EAF E81-E82 E84 E86-E8A E8C-EA3 EA5 EA7-EAE EB0 EB2-EB3 EBD EC0-EC4 EDC-EDD EB1 EB4-EBC EC8-ECD")
    assert SETS["armenian"] == expanded("531-556 559 560-588") + SETS["digits"] + SETS["punctuation"] + expanded("55A-55F 589-58A 58F")
    extended = "376-377 3DC-3DD 1F00-1F15 1F18-1F1D 1F20-1F45 1F48-1F4D 1F50-1F57 1F59 1F5B 1F5D 1F5F-1F70 1F72 1F74 1F76 1F78 1F7A 1F7C 1F80-1FAF 1FB2-1FB4 1FB6-1FB7"
    extended += " 1FBA 1FBC 1FC2-1FC4 1FC6-1FC8 1FCA 1FCC 1FD2-1FD3 1FD6-1FD7 1FDA 1FE2-1FE7 1FEA 1FEC 1FF2-1FF4 1FF6-1FF8 1FFA 1FFC"
    assert SETS["greek_extended"] == SETS["greek"] + expanded(extended)
    assert SETS["hebrew_specials"] == expanded("5EF-5F2 FB1D-FB36 FB38-FB3C FB3E FB40-FB41 FB43-FB44 FB46-FB4F")
    assert SETS["multilingual"].index("ō") < SETS["multilingual"].index("ċ")


def test_replaced():
    assert charsets.registry({"digits": "01"})["latin"].startswith("01a") and charsets.registry({"own": "aab"})["own"] == "ab"
