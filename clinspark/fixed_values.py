"""Values that are part of the data contract: word lists, limits, label maps, patterns.

Nothing in this file is logic. Every list is stated as plain text in its natural order so that
results agree with data produced by other tools that follow the same contract.
"""

from __future__ import annotations

# --- white space -------------------------------------------------------------------------------
# The white-space set of ECMAScript, as characters (for trimming) and as a regex class body that
# reads the same in java.util.regex and in RE2.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r              "
    "    　﻿"
)
SPACE_CLASS = (
    r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)

# --- personal-data rules -----------------------------------------------------------------------
# Canonical types.
ENTITY_TYPES = (
    "PERSON", "LOCATION", "DATE", "PHONE", "EMAIL", "ADDRESS", "ORGANIZATION", "ID_NUMBER", "AGE",
)

# Conversational words that never are personal data.
STOP_PHRASES = (
    "ja", "nee", "ok", "oké", "goed", "prima", "dank", "dank u", "bedankt",
    "hallo", "dag", "goedemorgen", "goedemiddag", "goedenavond",
    "wat", "wie", "waar", "wanneer", "hoe", "waarom",
    "mij", "mijn", "uw", "u", "hij", "zij", "wij", "hun", "hem", "haar",
    "twee", "drie", "vier", "vijf", "zes", "zeven", "acht", "negen", "tien",
    "patiënt", "patiënte", "pati", "patient",
    "noodgevallen", "vermoeidheid", "klachten", "medicatie", "behandeling",
    "contactpersoon", "contactgegevens", "rijbewijsnummer", "telefoonnummer",
    "mijn vrouw", "mijn man", "mijn huisarts", "mijn zoon", "mijn dochter",
    "mijn iban", "mijn bsn",
)

# Openings of conversational sentences.
CONVERSATION_OPENINGS = (
    "kunt u", "heeft u", "ik ben", "ik heb", "wilt u", "mag ik", "kan ik",
)

# Words that mark a span as strong personal data.
DUTCH_MONTHS = (
    "januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september",
    "oktober", "november", "december",
    "jan", "feb", "mrt", "apr", "jun", "jul", "aug", "sep", "okt", "nov", "dec",
)
STREET_WORDS = (
    "straat", "laan", "weg", "plein", "gracht", "dijk", "kade", "singel", "hof", "pad",
    "boulevard", "drive", "road", "street", "avenue", "lane",
)
CARE_TITLES = (
    r"dr\.?", "dokter", "huisarts", "arts", "psychiater", "psycholoog", "therapeut",
    "verpleegkundige", "specialist",
)
MEDICAL_ORGANISATIONS = (
    "huisartsenpraktijk", "praktijk", "ziekenhuis", "umc", "kliniek", "ggz", "apotheek",
    "medical center", "clinic", "hospital",
)
NAME_PARTICLES = (
    "de", "den", "der", "van", "van de", "van der", "ter", "ten", "op", "aan", "von", "da",
    "del", "la",
)
SURNAME_PARTICLES = ("van", "de", "der", "den", "ter", "ten", "op", "in", "het")

# Raw model label -> canonical type, one table per detector family.
TYPE_MAPS = {
    "multilingual_pii": {
        "GIVENNAME": "PERSON", "SURNAME": "PERSON", "EMAIL": "EMAIL", "TELEPHONENUM": "PHONE",
        "DATE": "DATE", "TIME": "DATE", "CITY": "LOCATION", "STREET": "ADDRESS",
        "BUILDINGNUM": "ADDRESS", "ZIPCODE": "ADDRESS", "AGE": "AGE", "SEX": "OTHER",
        "GENDER": "OTHER", "TITLE": "OTHER", "SOCIALNUM": "ID_NUMBER", "IDCARDNUM": "ID_NUMBER",
        "PASSPORTNUM": "ID_NUMBER", "DRIVERLICENSENUM": "ID_NUMBER",
        "CREDITCARDNUMBER": "ID_NUMBER", "TAXNUM": "ID_NUMBER", "ACCOUNTNUM": "ID_NUMBER",
    },
    "zero_shot_pii": {
        "name": "PERSON", "first name": "PERSON", "last name": "PERSON",
        "name medical professional": "PERSON", "dob": "DATE", "age": "AGE",
        "email address": "EMAIL", "phone number": "PHONE", "location address": "ADDRESS",
        "location street": "ADDRESS", "location city": "LOCATION", "location state": "LOCATION",
        "location country": "LOCATION", "location zip": "ADDRESS", "ssn": "ID_NUMBER",
        "healthcare number": "ID_NUMBER", "passport number": "ID_NUMBER",
        "driver license": "ID_NUMBER", "account number": "ID_NUMBER",
        "bank account": "ID_NUMBER", "credit card": "ID_NUMBER",
        "organization medical facility": "ORGANIZATION", "username": "ID_NUMBER",
    },
    "multilingual_ner": {
        "PER": "PERSON", "PERSON": "PERSON", "LOC": "LOCATION", "LOCATION": "LOCATION",
        "ORG": "ORGANIZATION", "ORGANIZATION": "ORGANIZATION", "MISC": "OTHER",
    },
    "privacy_filter": {
        "private_person": "PERSON", "private_email": "EMAIL", "private_phone": "PHONE",
        "private_address": "ADDRESS", "private_date": "DATE", "private_url": "OTHER",
        "account_number": "ID_NUMBER", "secret": "ID_NUMBER",
    },
}
ZERO_SHOT_THRESHOLD = 0.3
MIN_SPAN_SCORE = 0.1

# --- chunk sizes -------------------------------------------------------------------------------
# Fixed values: (max characters, overlap characters).
CHUNK_DEFAULT = (2400, 240)
CHUNK_LOW_MEMORY = (1600, 160)
CHUNK_SUMMARY = (3000, 200)
CHUNK_SENTENCES = 500
SINGLE_PASS_LIMIT = 6000
MERGE_FACT_LIMIT = 3500

# --- language lexicons -------------------------------------------------------------------------
# Function words counted by the two-language detector. "wordt" weighs three.
DUTCH_WORDS = (
    "de", "het", "een", "van", "en", "is", "dat", "voor", "niet", "met", "op", "aan", "uit",
    "maar", "ook", "naar", "als", "nog", "wordt", "zijn", "heeft", "deze", "dit", "bij", "kan",
    "over", "werd", "door", "meer", "wel", "geen", "hun", "onder", "na", "tot",
)
DUTCH_TRIPLE_WORD = "wordt"
ENGLISH_WORDS = (
    "the", "is", "and", "of", "to", "in", "that", "for", "with", "was", "on", "are", "this",
    "but", "not", "from", "have", "has", "had", "been", "were", "they", "will", "can", "would",
    "about", "which", "their", "said", "each",
)
DUTCH_DIGRAPHS = ("ij", "oe", "ui", "aa", "ee", "oo", "uu")
LANGUAGE_SAMPLE_NL_EN = 2000
LANGUAGE_MARGIN_NL_EN = 1.2

# Function words of the five-language detector, in tie-break order.
FIVE_LANGUAGE_WORDS = {
    "eng": (
        "the", "is", "and", "of", "to", "in", "that", "for", "with", "was", "on", "are", "this",
        "but", "not", "from", "have", "has", "had", "been", "were", "they", "will", "can",
        "about", "which", "their", "said",
    ),
    "nld": (
        "de", "het", "een", "van", "en", "is", "dat", "voor", "niet", "met", "op", "aan", "uit",
        "maar", "ook", "naar", "als", "nog", "wordt", "zijn", "heeft", "deze", "dit", "bij",
        "kan", "over", "werd", "door",
    ),
    "deu": (
        "der", "die", "das", "und", "ist", "nicht", "mit", "für", "von", "den", "dem", "sich",
        "auf", "auch", "ein", "eine", "sind", "wird", "wurde", "aber", "noch", "sein", "haben",
        "hat", "beim", "durch",
    ),
    "fra": (
        "le", "la", "les", "de", "des", "et", "est", "un", "une", "pour", "dans", "avec", "que",
        "qui", "sur", "ne", "pas", "par", "plus", "au", "aux", "ce", "cette", "son", "sa",
        "ses", "mais", "ou", "où",
    ),
    "spa": (
        "el", "la", "los", "las", "de", "y", "que", "en", "un", "una", "por", "con", "no",
        "para", "es", "se", "su", "sus", "del", "al", "como", "más", "pero", "también", "este",
        "esta", "sobre",
    ),
}
LANGUAGE_SAMPLE_FIVE = 4000
LANGUAGE_MIN_CHARS_FIVE = 40
LANGUAGE_MARGIN_FIVE = 1.3
LANGUAGE_MIN_SCORE_FIVE = 3

# --- imaging -----------------------------------------------------------------------------------
# Extensions and name prefixes used to recognise image files.
IMAGE_EXTENSIONS = ("dcm", "dicom", "dic")
IMAGE_NAME_PREFIXES = (
    "ct", "mr", "rs", "rp", "rd", "pt", "rtst", "rtpl", "rtdo", "rtim", "img", "im",
)
OTHER_EXTENSIONS = (
    "txt", "csv", "json", "xml", "html", "js", "css", "pdf", "doc", "docx", "xlsx", "xls", "zip",
    "rar", "7z", "tar", "gz", "exe", "dll", "jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif",
    "mp4", "avi", "log", "ini", "cfg", "bat", "sh", "py", "md", "yaml", "yml",
)
MIN_IMAGE_BYTES = 1024
MODALITY_PREFIXES = (
    ("CT", ("ct",)),
    ("MR", ("mr",)),
    ("RTSTRUCT", ("rs", "rtstruct")),
    ("RTPLAN", ("rp", "rtplan")),
    ("RTDOSE", ("rd", "rtdose")),
    ("PT", ("pt", "pet")),
)
IMAGING_MODALITIES = ("CT", "MR", "PT")
THERAPY_MODALITIES = ("RTSTRUCT", "RTPLAN", "RTDOSE")

# Sampling and read limits.
SERIES_MIN_FILES = 10
SAMPLES_PER_SERIES = 3
SIMILAR_SIZE_RATIO = 0.3
SERIES_MEDIAN_MIN = 100 * 1024
SERIES_MEDIAN_MAX = 2 * 1024 * 1024
HEADER_BYTES = 64 * 1024

# Data elements read from every header (public DICOM dictionary numbers).
CORE_TAGS = {
    "TransferSyntaxUID": 0x00020010,
    "SOPClassUID": 0x00080016,
    "SOPInstanceUID": 0x00080018,
    "StudyDate": 0x00080020,
    "StudyTime": 0x00080030,
    "AccessionNumber": 0x00080050,
    "Modality": 0x00080060,
    "Manufacturer": 0x00080070,
    "InstitutionName": 0x00080080,
    "StudyDescription": 0x00081030,
    "SeriesDescription": 0x0008103E,
    "PatientName": 0x00100010,
    "PatientID": 0x00100020,
    "PatientBirthDate": 0x00100030,
    "PatientSex": 0x00100040,
    "StudyInstanceUID": 0x0020000D,
    "SeriesInstanceUID": 0x0020000E,
    "SeriesNumber": 0x00200011,
    "InstanceNumber": 0x00200013,
    "FrameOfReferenceUID": 0x00200052,
}
# Further elements kept per modality.
OPTIONAL_TAGS = {
    "CT": (
        "SliceThickness", "KVP", "ConvolutionKernel", "Rows", "Columns", "PixelSpacing",
        "BitsAllocated", "WindowCenter", "WindowWidth", "ImagePositionPatient",
    ),
    "MR": (
        "MagneticFieldStrength", "EchoTime", "RepetitionTime", "FlipAngle", "Rows", "Columns",
        "PixelSpacing", "SliceThickness",
    ),
    "PT": ("Units", "Rows", "Columns", "SliceThickness"),
    "RTSTRUCT": ("StructureSetLabel", "StructureSetName"),
    "RTPLAN": ("RTPlanLabel", "RTPlanName", "PlanIntent"),
    "RTDOSE": ("DoseUnits", "DoseType", "DoseSummationType"),
}
# Those that label the folder of a therapy series.
LABEL_TAGS = ("StructureSetLabel", "RTPlanLabel", "DoseType")
OPTIONAL_TAG_NUMBERS = {
    "SliceThickness": 0x00180050,
    "KVP": 0x00180060,
    "RepetitionTime": 0x00180080,
    "EchoTime": 0x00180081,
    "MagneticFieldStrength": 0x00180087,
    "ConvolutionKernel": 0x00181210,
    "FlipAngle": 0x00181314,
    "ImagePositionPatient": 0x00200032,
    "Rows": 0x00280010,
    "Columns": 0x00280011,
    "PixelSpacing": 0x00280030,
    "BitsAllocated": 0x00280100,
    "WindowCenter": 0x00281050,
    "WindowWidth": 0x00281051,
    "Units": 0x00541001,
    "DoseUnits": 0x30040002,
    "DoseType": 0x30040004,
    "DoseSummationType": 0x3004000A,
    "StructureSetLabel": 0x30060002,
    "StructureSetName": 0x30060004,
    "RTPlanLabel": 0x300A0002,
    "RTPlanName": 0x300A0003,
    "PlanIntent": 0x300A000A,
}
# Value representations with a 12-byte element header.
LONG_VALUE_REPRESENTATIONS = ("OB", "OD", "OF", "OL", "OW", "SQ", "UC", "UN", "UR", "UT")
IMPLICIT_TRANSFER_SYNTAX = "1.2.840.10008.1.2"
UNREADABLE_TRANSFER_SYNTAXES = ("1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99")

# Placeholders.
UNKNOWN_PATIENT = "UNKNOWN"
UNKNOWN_STUDY = "UNKNOWN_STUDY"
UNKNOWN_SERIES = "UNKNOWN_SERIES"
UNKNOWN_MODALITY = "UNKNOWN"
NO_DATE = "NoDate"
NO_DESCRIPTION = "NoDescription"
COPY_BATCH = 50

# --- redaction ---------------------------------------------------------------------------------
MIN_TEXT_CHARS = 20
BOX_PADDING = 2.0

# --- speech ------------------------------------------------------------------------------------
SAMPLE_RATE = 16000
SILENCE_RMS = 0.01
MIN_CHUNK_SECONDS = 5
MAX_CHUNK_SECONDS = 20
LONG_WINDOW_SECONDS = 30
LONG_STRIDE_SECONDS = 5
REPEAT_SHARE = 0.6
NO_SPEECH = "(no speech detected)"
TRANSCRIPTION_FAILED = "(transcription failed)"
# Transcripts that speech models invent on silence (case-insensitive).
INVENTED_TRANSCRIPTS = (
    r"^\.+$",
    r"^(,SPACE*)+$",
    r"^SPACE*$",
    "ondertitels",
    "subtitl",
    "gelderland",
    r"amara\.org",
    r"www\.",
    "copyright",
    "thank you for watching",
    "thanks for watching",
    "bedankt voor het kijken",
    "tot de volgende keer",
)

# --- files -------------------------------------------------------------------------------------
MAX_DOCX_BYTES = 10 * 1024 * 1024
AUDIO_EXTENSIONS = ("mp3", "wav", "ogg", "webm", "m4a", "flac", "mp4")
ANONYMIZE_EXTENSIONS = ("xlsx", "docx", "txt", "pdf")
TEXT_EXTENSIONS = ("txt", "docx", "xlsx")
