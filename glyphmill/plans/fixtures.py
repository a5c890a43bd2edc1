"""Small texts of our own that exercise what the synthetic tables don't: phrases, paragraphs, citations, mark-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.sources.tables import read, spread

BASE = 9_000_000_000
_SCAFFOLD = "Selain itu, kampus dapat meningkatkan layanan bagi semua orang di kota. Pertama, perlu diingat bahwa guru dan siswa sering bekerja bersama di kelas. "
_LONG = "Kampus kecil ini berdiri di tepi sungai dan menerima banyak tamu setiap musim panas tanpa henti. "

TEXTS = [
    "Selain itu, teknologi dapat meningkatkan kualitas belajar. Dengan demikian, kampus dapat memberikan berbagai kemudahan. Kesimpulannya, hal ini penting untuk dicatat.",
    "First, the system is fast and the cost is low. Second, it is important to note that the data in the report are old. Furthermore, the team can delve into the results.",
    "Data ini adalah hasil dari survei yang sudah selesai. The results of this survey are in the table. Kami juga menulis catatan untuk tim.",
    "Metode survei dipakai pada 120 responden [1]. Hasil (Santoso, 2020) menunjukkan 40 persen siswa hadir. Lihat https://example.org/a dan DOI:10.1/x sekarang juga.",
    "Saya rasa hasilnya bagus sekali! Apakah kita sudah siap? Menurut saya, kami perlu waktu lagi.",
    "Kata kata kata.",
    "",
    _SCAFFOLD * 4 + "Kesimpulannya, perlu diingat bahwa hal tersebut sangat penting bagi kampus. Secara keseluruhan, dengan demikian semua orang merasa senang.",
    (_LONG * 6) + "\n\nParagraf pendek di sini saja.\n\n" + _LONG * 2 + "Namun kami tidak pernah lelah!\nDaftar Pustaka\nSantoso, B. (2020). Judul buku. Penerbit Kota.",
    "# Judul\n\n- butir **tebal** satu\n- butir *miring* dua\n1. angka `kode` tiga\n> kutipan [tautan](https://x.org/a) dan ![gambar](b.png)\n\n```py\nprint(1)\n```\na | b | c ~~hapus~~ __kuat__ _pelan_ akhir\n---\nselesai sudah semua",
    "Penelitian ini bertujuan menguji hipotesis dengan kuesioner pada 120 responden [1]. Metode observasi dan wawancara dipakai (Santoso, 2020). Sampel berasal dari populasi Kota Bandung dan Kota Malang pada 2021. Variabel diukur dengan instrumen baku [2, 3]. "
    "Jurnal dari Universitas Airlangga memuat 45 kasus dan 30 persen mahasiswa. Berdasarkan hasil penelitian, responden dari Jakarta lebih banyak hadir daripada responden dari Surabaya pada 2019. Hasil dan pembahasan ada pada bab 3 dan bab 4. Kesimpulan ditulis oleh Budi Hartono pada 12 Mei 2022 setelah semua data lengkap.",
    'Bayangkan kisah ini: "aku pulang", kata ibu. Coba nikmati kopi gratis di kedai kami! Hubungi kami segera tanpa perlu antre. Seperti mimpi, rasanya enak sekali? I think that it\'s good, and in my opinion you should try it.',
    "Budi Santoso writes <b>code</b> & \"tests\" for Acme Corp in NASA's lab; contact team@acme.example or run main() in pkg.module.name today.",
    "Жук идёт éa é naïve café, ok. 🎉".encode("utf-16", "surrogatepass").decode("utf-16"),
]


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(BASE + i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def texts_sql() -> str:
    return "(VALUES " + ", ".join(f"({BASE + i}, {quoted(t)})" for i, t in enumerate(TEXTS)) + ") v(doc_id, text)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of all documents and of the fixtures."""
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).unionByName(texts(spark).coalesce(1))


DOCUMENTS_SQL = f"d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {texts_sql()})"
