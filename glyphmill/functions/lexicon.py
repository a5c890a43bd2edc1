"""Signal vocabularies and scoring constants.

Fixed values: word lists and numbers that results depend on, stated as they are.
"""

AI_ID = [
    "sebagai model bahasa", "penting untuk dicatat", "secara keseluruhan", "dalam konteks", "pada dasarnya", "kesimpulannya", "perlu diingat",
    "dalam era digital", "memainkan peran penting", "tidak dapat dipungkiri",
]
AI_EN = [
    "as an ai language model", "it is important to note", "overall,", "in conclusion", "in today's fast-paced", "delve into", "plays a crucial role",
    "it is worth noting", "this article explores",
]
ACAD_NEUTRAL = [
    "penelitian ini bertujuan", "artikel ini membahas", "dengan demikian", "oleh karena itu", "selain itu", "dapat disimpulkan",
    "berdasarkan hasil penelitian",
]
ID_FW = [
    "yang", "dan", "di", "ke", "dari", "dengan", "untuk", "pada", "ini", "itu", "adalah", "akan", "juga", "dalam", "oleh", "sebagai", "tidak", "atau",
    "karena", "serta", "antara", "melalui", "para", "sudah", "telah", "sangat", "lebih", "dapat", "bisa", "menjadi", "ada", "saya", "kami", "kita",
    "maka", "sehingga", "namun", "tetapi", "agar", "bila", "jika", "kalau", "supaya", "hanya", "sekali", "semua", "setiap", "paling", "terus", "lagi",
    "masih",
]
EN_FW = [
    "the", "and", "of", "to", "in", "is", "are", "was", "were", "a", "an", "for", "with", "on", "that", "this", "these", "those", "it", "as", "by",
    "at", "from", "be", "been", "being", "which", "who", "whom", "not", "than", "but", "or", "if", "when", "while", "also", "can", "will", "would",
    "should", "may", "might", "has", "have", "had", "their", "its", "our", "your", "my", "them", "they", "we", "you", "he", "she", "i", "there",
    "then", "so", "do", "does", "did", "about", "into", "over", "after", "before", "under", "during", "between",
]
REF_HEADS = [
    "daftar pustaka", "references", "bibliography", "referensi", "daftar referensi",
]
AI_PHRASES = AI_ID + AI_EN
FLUFF_EXTRA = [
    "semakin populer", "kini menawarkan", "telah mengubah", "membantu bisnis", "gunakan dasbor", "membuat keputusan yang lebih baik",
    "sempurna untuk", "menjaga minuman",
]
VOICE_EXTRA = [
    "perkenalkan", "berangkatlah", "masukkan ke dalam", "lebih sedikit", "lebih banyak", "hubungi", "segera", "tanpa perlu", "risiko", "kampanye",
]
CONNECTORS = [
    "selain itu", "dengan demikian", "selanjutnya", "furthermore", "moreover", "however", "therefore",
]
BENEFIT = [
    "memiliki peran yang penting", "memiliki peran yang signifikan", "memainkan peran penting", "memainkan peran yang penting",
    "memegang peranan penting", "berperan penting", "berperan signifikan", "dapat meningkatkan", "membantu meningkatkan", "meningkatkan kualitas",
    "meningkatkan efektivitas", "meningkatkan efisiensi", "meningkatkan produktivitas", "dapat memberikan", "memberikan berbagai",
    "berbagai kemudahan", "berbagai manfaat", "berbagai fitur", "dampak yang positif", "manfaat yang positif", "diharapkan dapat",
    "diharapkan memberikan", "menawarkan berbagai", "dirancang untuk membantu", "dapat mendukung",
]
ENUM_ID = [
    "pertama", "kedua", "ketiga", "keempat", "selanjutnya", "terakhir",
]
ENUM_EN = [
    "first", "second", "third", "fourth", "finally", "lastly",
]
SCAFFOLD = [
    "pada akhirnya", "secara keseluruhan", "perlu diingat", "diingat bahwa", "kesimpulannya",
]
METHOD = [
    "metode", "metodologi", "variabel", "responden", "sampel", "populasi", "observasi", "wawancara", "kuesioner", "hipotesis", "instrumen", "jurnal",
    "penelitian", "bab [1-5]", "skripsi", "tesis",
]
PERSONAL = [
    "saya", "aku", "gue", "kami", "kita", "menurutku", "menurut saya", "saya rasa", "sejujurnya", "terus terang", "pengalaman", "bagiku", "don't",
    "can't", "won't", "it's", "that's", "i think", "in my opinion",
]
FLUFFY = [
    "sangat penting", "perlu diperhatikan", "perlu diketahui", "dapat meningkatkan", "dapat membantu", "membantu meningkatkan", "berbagai macam",
    "secara umum", "pada umumnya", "hal tersebut",
]
VOICE_LIVE = [
    "coba", "rasakan", "dapatkan", "nikmati", "bayangkan", "jangan lewatkan", "gratis", "garansi", "seperti", "bagai", "ibarat", "laksana", "umpama",
    "kisah", "ceritaku", "jujur",
]
SENT_PERSONAL = [
    "saya", "gue", "aku", "dosen saya", "pengalaman", "menurutku", "menurut saya", "sejujurnya", "terus terang", "bayangkan", "jujur", "kisah",
    "don't", "can't", "won't", "i think", "in my opinion",
]
SENT_TEMPLATE = [
    "sangat penting", "dapat meningkatkan", "membantu meningkatkan", "secara umum", "pada umumnya", "memainkan peran penting",
    "tidak dapat dipungkiri",
]
SENT_DATA = [
    "responden", "kasus", "mahasiswa", "persen",
]
SECTIONS = ["pendahuluan", "metode", "metodologi", "hasil", "pembahasan", "kesimpulan", "abstrak", "tujuan penelitian", "populasi", "sampel", "responden", "kuesioner", "observasi", "wawancara", "uji ", "analisis data"]

# Limits and scoring constants.
MIN_WORDS, MAX_CHARS = 20, 30000
SCORE_FLOOR, SCORE_CEIL, SCORE_ANCHOR = 15, 98, 22
SHORT_W, SHORT_SENTS, SHORT_TEXT_CAP = 50, 3, 45
MIN_RELIABLE_W, LEX_MIN_W, MED_MIN_W, HEDGE_MIN_W, IMPERS_MIN_W = 80, 50, 60, 40, 50
SINGLE_SIGNAL_CAP = 60
TEMPLATE_MAX, RHYTHM_MAX, STRUCTURE_MAX, LEXICAL_MAX, HUMAN_LIKE_MAX = 36, 20, 18, 20, 14
ACAD_DAMP = {"LOW": 2, "MEDIUM": 6, "HIGH": 10}
BLEND_LOW, BLEND_RANGE, BLEND_MAX = 8, 24, 0.6
STRONG_DOC, MID_DOC, HUMAN_DOC = 75, 50, 30
IDEA_SENTS = 300
S1_MIN_W, S1_DENSITY, S1_DISPERSION, S1_DISTINCT, S1_POINTS, S1_SENT_POINTS = 50, 3.0, 2, 2, 8, 14

# Structure of a text, as its explanation reads it.
EXPLAIN_SECTIONS = ["abstrak", "pendahuluan", "latar belakang", "tujuan penelitian", "metode", "metodologi", "hasil", "pembahasan", "kesimpulan", "saran"]
EXPLAIN_CONNECTORS = [
    "selain itu", "dengan demikian", "oleh karena itu", "berdasarkan", "namun", "tetapi", "sehingga", "kemudian", "pertama", "kedua", "however", "moreover",
    "furthermore", "therefore", "in addition",
]
EXPLAIN_VOICE = ["saya", "kami", "kita", "penulis", "menurut saya", "pengalaman"]

# Genericness of a sentence. One word is there twice and counts twice.
GENERIC_PHRASES = ["salah satu", "memang", "cukup", "dekat", "umumnya", "terlihat", "tampak", "dapat dikatakan", "tidak sedikit", "bagi banyak", "bagi kita"]
GENERIC_WORDS = [
    "umum", "umumnya", "sering", "kadang", "banyak", "beberapa", "salah", "seperti", "memang", "cukup", "dekat", "juga", "para", "hal", "kita", "mereka", "jadi",
    "terbanyak", "umumnya",
]

# Words that retrieval never takes for content.
STOPWORDS = (
    "yang dan atau dengan untuk dari pada adalah ini itu sebagai dalam juga tidak akan telah oleh karena dapat antara terhadap serta bagi secara yaitu yakni namun "
    "tetapi sehingga agar supaya masih sudah harus bisa bahwa hanya tanpa pula hal tersebut the and or with for from that this these those are was were been has "
    "have had will would can could which such their there here into about over under between through during within study research paper using used based"
).split()
GENERIC_TERMS = (
    "penelitian artikel abstrak jurnal prosiding makalah skripsi tesis disertasi bidang ilmunya ilmu pengetahuan teknologi masyarakat hasil analisis pendahuluan "
    "pembahasan kesimpulan saran metode metodologi pendekatan landasan kerangka kontribusi tujuan latar belakang tinjauan pustaka referensi publikasi menurut "
    "digunakan dilakukan ditunjukkan berdasarkan terdapat merupakan menjadi sehingga hal dapat ini tersebut tetapi namun serta dalam pada dengan dari untuk yang "
    "perlu satu banyak semua harus lain masa cara mesti agar supaya bahwa hanya telah masih juga kedua ketiga keempat umum umumnya sebagian terbesar istilah "
    "melalui yaitu"
).split()
GENERIC_NOUNS = "hewan ternak makhluk benda tumbuhan hasil orang negara daerah kota".split()

# Words that a capital letter does not make a term.
CAP_FUNCTION_WORDS = [
    "yang", "dan", "atau", "tetapi", "namun", "sehingga", "karena", "untuk", "dari", "pada", "dalam", "dengan", "sebagai", "oleh", "tentang", "antara", "adalah",
    "yaitu", "bahwa", "ini", "itu", "mereka", "kita", "kamu", "akan", "dapat", "sudah", "masih", "juga", "hanya", "seperti", "tidak", "bukan", "telah", "harus",
    "boleh", "mulai", "selama", "ketika", "setelah", "sebelum", "melalui", "berdasarkan", "umumnya", "biasanya", "selain", "kemudian", "serta", "hingga", "sampai",
    "bagi", "kelinci", "hewan", "spesies", "mamalia", "tumbuhan", "manusia", "sistem", "proses", "kondisi", "hasil", "penelitian", "peran", "role",
]

# Retrieval: limits and weights.
TOPIC_N, ANCHOR_N, CONTEXT_N, ENTITY_N = 6, 2, 6, 6
RECALL_FULL, BREADTH_FULL, MIN_BREADTH, CTX_FULL, CTX_NEUTRAL_BELOW, CTX_GATE, ENT_FULL, ENT_NEUTRAL = 0.35, 3, 2, 0.35, 0.15, 0.30, 2, 0.6
W_SEM, W_TOPIC, W_CTX, W_ENT = 0.45, 0.25, 0.20, 0.10
B_SEM, B_LEX, B_CTX = 0.55, 0.25, 0.20
SEM_GATE, SEM_HIGH, MIN_RELEVANCE, MAX_RESULTS = 0.62, 0.72, 0.70, 10
CLUSTER_MARGIN, MIN_TOP_CONF, CONF_TOP_HIGH = 0.06, 0.55, 0.75
TIER_ORDER = {"Jurnal/paper": 0, "Wikipedia/Wikidata": 1, "Umum": 2}
TIER_QUALITY = {"Jurnal/paper": 1.0, "Wikipedia/Wikidata": 0.92, "Umum": 0.85}
DIGEST_CHARS = 1800

# Fusion of two scores.
MAX_LIFT, AGREE_GAP = 5, 30

# Wording of reports; %s are filled in order.
REASONS = {
    "rhythm_uniform_varied": "Variasi kalimat seragam (%s) tetapi variasi kata/paragraf cukup (kata %s, paragraf %s) — tidak serta-merta mekanis.",
    "rhythm_uniform": "Variasi kalimat cukup seragam (%s) — pola yang sering ditemukan pada teks generatif.",
    "rhythm_even": "Variasi kalimat agak seragam (%s).",
    "rhythm_natural": "Variasi kalimat cukup alami (%s) — pola yang umum pada tulisan manusia.",
    "rhythm_flat": "Ritme kalimat sangat datar (%s).",
    "ttr_generic": "TTR %s disertai frasa generik — terdapat indikasi pola generatif.",
    "ttr_high": "TTR tinggi %s — kosakata bervariasi seperti tulisan manusia.",
    "ttr_low": "Pengulangan kata cukup tinggi (%s).",
    "ngrams_repeat": "Pola kata berulang cukup tinggi (bigram %s, trigram %s) — frasa yang sama terpakai berulang.",
    "ngrams_varied": "Pola kata bervariasi (trigram %s) — pilihan kata tidak monoton.",
    "template_phrases": "%s frasa template/generik ditemukan — perlu ditinjau dalam konteks kalimatnya.",
    "connectors": "Kata penghubung formal cukup sering berulang (%s/kalimat) — yang dinilai polanya, bukan pemakaiannya.",
    "tidy_lengths": "80%%+ kalimat 12-28 kata — ritme terlalu rapi, perlu ditinjau.",
    "personal_voice": "Ada suara personal/opini (%sx) — sudut pandang penulis terasa.",
    "impersonal_academic": "Nada impersonal pada teks akademik (register formal) — bukan bukti AI.",
    "impersonal": "Belum ada sudut pandang personal — tulisan terdengar generik.",
    "lively": "%sx tanda tanya/seru/kutipan — tulisan terasa hidup.",
    "concrete": "Ada detail konkret (%s angka, %s nama) — konteksnya spesifik.",
    "paragraphs_varied": "Paragraf terstruktur dan bervariasi (%s paragraf) — seperti tulisan manusia.",
    "one_paragraph": "Seluruh teks satu paragraf panjang — strukturnya datar, perhatikan organisasi tulisan.",
    "openers_repeat": "Pembuka kalimat banyak berulang — struktur terasa monoton.",
    "openers_varied": "Pembuka kalimat bervariasi — struktur cukup alami.",
    "ideas_repeat": "%s pasang kalimat menyampaikan ide yang mirip — pertimbangkan digabung agar tidak repetitif.",
    "fluffy": "Frasa generik cukup sering (%sx) — tulisan terdengar umum, perlu konteks spesifik.",
    "expressions": "Ada variasi ekspresi (%sx: ajakan, manfaat, perumpamaan) — gaya cukup hidup.",
    "benefit": "%s kalimat memakai frasa manfaat generik (\"dapat meningkatkan\", \"memberikan manfaat\", \"berperan penting\") — ciri bahasa template hasil model.",
    "enumeration": "%s kalimat memakai pola enumerasi (\"Pertama... Kedua...\") — struktur daftar khas template.",
    "academic": "Konteks akademik %s terdeteksi (sitasi/data/metodologi) — formalitas di sini kemungkinan academic convention; confidence disesuaikan.",
    "rhythm_discounted": "Keseragaman ritme pada teks akademik tanpa bukti template — dijelaskan konvensi formal, bobot uniformitas dikurangi.",
    "formal_only": "Pola yang ada hanya formalitas umum tulisan akademik — indikasi tetap rendah.",
    "research_evidence": "Bukti riset lengkap (metodologi, data, sitasi) — gaya formal ini lazim pada tulisan akademik manusia.",
    "neutral_phrases": "%s frasa akademik standar (mis. \"penelitian ini bertujuan\", \"selain itu\") terdeteksi — bahasa akademik normal, tidak dihitung sebagai indikasi AI.",
    "scaffold_neutral": "Frasa akademik dipakai berulang (%sx) tanpa dukungan data/metodologi/sitasi — scaffolding khas teks generatif.",
    "scaffold_spread": "Pola scaffolding ID tersebar (%s kemunculan, %s frasa berbeda di %s kalimat/paragraf, densitas %s%%) — kombinasi yang perlu ditinjau dalam konteksnya.",
    "single_signal": "Hanya satu pola terdeteksi — belum cukup untuk indikasi kuat (perlu multiple signals + konteks).",
    "under_80_words": "Teks <80 kata — statistik gaya bahasa belum bermakna, tambah ke 200+ kata.",
    "too_short": "Teks terlalu singkat untuk analisis pola yang meyakinkan.",
    "wide_spread": "Sebaran skor antar kalimat cukup lebar (±%s) — konsistensi dipakai sebagai penyesuai confidence (bukan bukti), sehingga confidence diturunkan.",
    "mixed_language": "Teks campuran dua bahasa terdeteksi (ID %s%% / EN %s%% function-word) — atribusi bahasa tidak pasti sehingga confidence diturunkan satu tingkat.",
    "no_pattern": "Tidak ditemukan pola AI yang jelas — skor hanya mencerminkan minimnya evidence, bukan bukti kepengarangan.",
}
SENTENCE_ZONES = ("terindikasi perlu ditulis ulang", "perlu ditinjau", "cenderung natural")
DISPLAY_BANDS = ("Indikasi AI kuat", "Campuran", "Indikasi ringan", "Cenderung natural")
TRIGGERS = {
    "phrase": "frasa generik “%s”", "template": "pola template “%s”", "benefit": "frasa manfaat generik “%s”",
    "academic": "frasa akademik “%s” tanpa dukungan data/metodologi/sitasi di sekitarnya", "enumeration": "pola enumerasi di awal kalimat",
    "opener": "pembuka kalimat yang berulang dengan kalimat lain", "tidy": "panjang 12–28 kata yang polanya rapi",
    "personal": "memuat sudut pandang/tanda penulis", "data": "memuat detail konkret (angka/nama)", "marks": "memuat tanda tanya/seru/kutipan langsung", "odd_length": "panjang di luar pola rapi",
    "no_up": "pola panjang yang rapi di antara kalimat sekitarnya", "no_down": "tidak banyak pola generatif",
}
ADVICE = {
    "generic": "Saran: ganti bagian generik dengan rincian spesifik (data, contoh, atau konteks) bila tersedia.",
    "opener": "Saran: variasikan pembuka dan panjang kalimat di sekitarnya.",
    "other": "Saran: variasikan panjang kalimat dan tambah konteks spesifik bila tersedia.",
}
SENTENCE_HEAD = "Kalimat %s/%s — skor indikasi %s/100 (%s; bukan probabilitas)."
SENTENCE_REVIEW, SENTENCE_SAFE = "%s Pemicu utama: %s. %s", "%s Kalimat ini aman karena %s — pertahankan. Saran: pertahankan; tidak perlu diubah."
BULLETS = {
    "empty": "Teks kosong — belum ada struktur yang dapat dijelaskan.",
    "counts": "Teks terdiri dari %s paragraf dan %s kalimat (%s kata, rata-rata %s kata/kalimat).",
    "sections": "Terdeteksi penanda bagian: %s — alur tulisan mengikuti konvensi akademik.",
    "no_sections": "Tidak terdeteksi penanda bagian formal (mis. pendahuluan/metode/hasil) — alur kemungkinan naratif umum.",
    "enumeration": "%s kalimat memakai pola enumerasi — struktur daftar, perlu ditinjau variasinya.",
    "connectors": "%s kata penghubung formal terhitung — yang dinilai polanya, bukan pemakaiannya.",
    "no_connectors": "Belum terhitung kata penghubung formal yang menonjol.",
    "concrete": "Konteks konkret teramati: %s angka dan %s penanda sitasi/tautan.",
    "not_concrete": "Belum teramati angka/sitasi konkret — tulisan masih umum, dapat diperkuat data bila tersedia.",
    "voice": "Terdengar %s penanda suara penulis — sudut pandang penulis hadir.",
    "no_voice": "Belum terdengar suara personal penulis — tulisan bernada impersonal.",
}
SHORTENED = "Beberapa kalimat pendukung tidak verbatim dari teks; dibuang dari jejak audit."
FAILURES = {
    "timeout": "Pemeriksaan AI melebihi batas waktu — dipakai hasil lokal.", "offline": "Pemeriksaan AI tidak terjangkau (offline?) — dipakai hasil lokal.",
    "rate-limited": "Pemeriksaan AI dibatasi server — dipakai hasil lokal.", "unauthorized": "Pemeriksaan AI tidak diizinkan — dipakai hasil lokal.",
    "malformed": "Respons AI tidak lengkap — dipakai hasil lokal.", "unavailable": "Pemeriksaan AI tidak tersedia — dipakai hasil lokal.",
}
STAGES = {
    "idle": "Siap.", "preparing": "Menyiapkan teks...", "local": "Menjalankan pemeriksaan lokal...", "ai": "Menjalankan pemeriksaan AI...", "combining": "Menggabungkan hasil...",
    "validating": "Memvalidasi hasil...", "done": "Selesai — skor indikasi, bukan vonis.",
}
