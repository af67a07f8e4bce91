"""Tables, patterns and thresholds that rules refer to.

They are facts of the file format, of its registry, or of the rules themselves, so they are stated as they are.
``ord`` is the position in a table; where several rows match, the smallest one wins.
"""

from __future__ import annotations

# --- fixed values: signatures of executables and archives, longest and most specific first ---
SIGNATURES: list[tuple[bytes, str]] = [
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "OLE compound file"),
    (b"\x7fELF", "ELF executable"),
    (b"\xca\xfe\xba\xbe", "Mach-O or Java class"),
    (b"\xcf\xfa\xed\xfe", "Mach-O 64-bit"),
    (b"\xce\xfa\xed\xfe", "Mach-O 32-bit"),
    (b"PK\x03\x04", "ZIP archive"),
    (b"Rar!\x1a\x07", "RAR archive"),
    (b"7z\xbc\xaf\x27\x1c", "7-Zip archive"),
    (b"\xfd7zXZ\x00", "XZ archive"),
    (b"\x28\xb5\x2f\xfd", "Zstandard archive"),
    (b"MSCF", "Cabinet archive"),
    (b"BZh", "bzip2 archive"),
    (b"\x04\x22\x4d\x18", "LZ4 frame"),
    (b"\x00asm", "WebAssembly module"),
    (b"dex\n", "Android DEX"),
    (b"\x1bLua", "Lua bytecode"),
    (b"!<arch>", "ar archive"),
    (b"\xed\xab\xee\xdb", "RPM package"),
    (b"%PDF", "PDF document"),
    (b"\x1f\x8b", "gzip data"),
    (b"MZ", "PE executable"),
    (b"#!", "shell script"),
]

# --- fixed values: value representations of the file format ---
LONG_VRS = "OB OW OF OD OL OV SQ UC UR UT UN".split()
VALID_VRS = "AE AS AT CS DA DS DT FL FD IS LO LT OB OD OF OL OV OW PN SH SL SQ SS ST SV TM UC UI UL UN UR US UT UV".split()
UNDEFINED_LENGTH = 0xFFFFFFFF

# --- fixed values: transfer syntaxes (below 1.2.840.10008.1.2), their short names and decoders ---
_UID = "1.2.840.10008.1.2"
TRANSFER_SYNTAXES: list[tuple[str, str, str]] = [
    (_UID, "Implicit VR LE", "native"),
    (_UID + ".1", "Explicit VR LE", "native"),
    (_UID + ".1.99", "Deflated Explicit LE", "zlib"),
    (_UID + ".2", "Explicit VR BE", "native"),
    (_UID + ".5", "RLE Lossless", "RLE"),
    (_UID + ".4.50", "JPEG Baseline", "libjpeg"),
    (_UID + ".4.51", "JPEG Extended", "libjpeg"),
    *[(f"{_UID}.4.{i}", f"JPEG process {i} (retired)", "libjpeg") for i in range(52, 57)],
    (_UID + ".4.57", "JPEG Lossless", "libjpeg"),
    *[(f"{_UID}.4.{i}", f"JPEG process {i} (retired)", "libjpeg") for i in range(58, 67)],
    (_UID + ".4.70", "JPEG Lossless SV1", "libjpeg"),
    (_UID + ".4.80", "JPEG-LS Lossless", "CharLS"),
    (_UID + ".4.81", "JPEG-LS Near-Lossless", "CharLS"),
    (_UID + ".4.90", "JPEG 2000 Lossless", "OpenJPEG"),
    (_UID + ".4.91", "JPEG 2000", "OpenJPEG"),
    (_UID + ".4.92", "JPEG 2000 Part 2 Lossless", "OpenJPEG"),
    (_UID + ".4.93", "JPEG 2000 Part 2", "OpenJPEG"),
    (_UID + ".4.94", "JPIP Referenced", "OpenJPEG"),
    (_UID + ".4.95", "JPIP Referenced Deflate", "OpenJPEG"),
    (_UID + ".4.201", "HTJ2K Lossless", "OpenJPH"),
    (_UID + ".4.202", "HTJ2K Lossless RPCL", "OpenJPH"),
    (_UID + ".4.203", "HTJ2K", "OpenJPH"),
    (_UID + ".4.100", "MPEG2 Main Level", "FFmpeg-class"),
    (_UID + ".4.101", "MPEG2 High Level", "FFmpeg-class"),
    (_UID + ".4.102", "H.264 4.1", "FFmpeg-class"),
    (_UID + ".4.103", "H.264 BD 4.1", "FFmpeg-class"),
    (_UID + ".4.104", "H.264 4.2 2D", "FFmpeg-class"),
    (_UID + ".4.105", "H.264 4.2 3D", "FFmpeg-class"),
    (_UID + ".4.106", "H.264 4.2 stereo", "FFmpeg-class"),
    (_UID + ".4.107", "HEVC 5.1", "FFmpeg-class"),
    (_UID + ".4.108", "HEVC 10 5.1", "FFmpeg-class"),
]
#: Recognised by the metadata rule; the retired JPEG processes aren't.
KNOWN_SYNTAXES = [u for u, n, _ in TRANSFER_SYNTAXES if "retired" not in n]
JPIP = [_UID + ".4.94", _UID + ".4.95"]
SAFE_DECODERS = ["native", "RLE"]
IMPLICIT_LE, EXPLICIT_LE, DEFLATED_LE, EXPLICIT_BE, RLE = _UID, _UID + ".1", _UID + ".1.99", _UID + ".2", _UID + ".5"
#: Pixel data stored as it is: for the metadata rule (a file without a syntax counts), and for rebuilding.
NATIVE_FOR_SIZE = [IMPLICIT_LE, EXPLICIT_LE, DEFLATED_LE, EXPLICIT_BE, ""]
NATIVE_FOR_REBUILD = [IMPLICIT_LE, EXPLICIT_LE, EXPLICIT_BE]
LOSSLESS_ENCAPSULATED = [RLE, *[f"{_UID}.4.{i}" for i in (57, 58, 65, 66, 70, 80, 90, 92, 201, 202)]]

# --- fixed values: decoders and known vulnerabilities (id, score) ---
CODEC_CVES: dict[str, list[tuple[str, float]]] = {
    "OpenJPEG": [("CVE-2020-27814", 8.8), ("CVE-2021-29338", 5.5), ("CVE-2018-5785", 8.8), ("CVE-2020-15389", 6.5)],
    "libjpeg": [("CVE-2020-13790", 7.5), ("CVE-2018-19664", 8.8), ("CVE-2018-20330", 8.8)],
    "CharLS": [],
    "OpenJPH": [],
    "FFmpeg-class": [("CVE-2016-10190", 8.8)],
    "zlib": [("CVE-2022-37434", 9.8), ("CVE-2018-25032", 7.5)],
    "RLE": [],
}

# --- fixed values: modalities ---
MODALITIES = (
    "CR CT MR US XA NM PT MG DX RF OT BI CD DD DG ES LS RG TG IO PX GM SM XC PR AU ECG EPS HD SR IVUS OP SMR AR KER VA SRF OCT OPM "
    "OPV OPR LEN DOC SC RTIMAGE RTDOSE RTSTRUCT RTPLAN RTRECORD SEG REG KO HC"
).split()

# --- fixed values: tags of the Basic Confidentiality Profile, with its action ---
PROFILE_TAGS: list[tuple[int, int, str, str]] = [
    (0x0008, 0x0050, "AccessionNumber", "Z"),
    (0x0008, 0x0080, "InstitutionName", "X"),
    (0x0008, 0x0081, "InstitutionAddress", "X"),
    (0x0008, 0x0090, "ReferringPhysicianName", "Z"),
    (0x0008, 0x0092, "ReferringPhysicianAddress", "X"),
    (0x0008, 0x0094, "ReferringPhysicianTelephoneNumbers", "X"),
    (0x0008, 0x1010, "StationName", "X"),
    (0x0008, 0x1030, "StudyDescription", "X"),
    (0x0008, 0x103E, "SeriesDescription", "X"),
    (0x0008, 0x1040, "InstitutionalDepartmentName", "X"),
    (0x0008, 0x1048, "PhysiciansOfRecord", "X"),
    (0x0008, 0x1050, "PerformingPhysicianName", "X"),
    (0x0008, 0x1060, "NameOfPhysiciansReadingStudy", "X"),
    (0x0008, 0x1070, "OperatorsName", "X"),
    (0x0010, 0x0010, "PatientName", "Z"),
    (0x0010, 0x0020, "PatientID", "Z"),
    (0x0010, 0x0030, "PatientBirthDate", "Z"),
    (0x0010, 0x0032, "PatientBirthTime", "X"),
    (0x0010, 0x0040, "PatientSex", "Z"),
    (0x0010, 0x1000, "OtherPatientIDs", "X"),
    (0x0010, 0x1001, "OtherPatientNames", "X"),
    (0x0010, 0x1010, "PatientAge", "X"),
    (0x0010, 0x1020, "PatientSize", "X"),
    (0x0010, 0x1030, "PatientWeight", "X"),
    (0x0010, 0x1040, "PatientAddress", "X"),
    (0x0010, 0x2154, "PatientTelephoneNumbers", "X"),
    (0x0010, 0x2160, "EthnicGroup", "X"),
    (0x0010, 0x21B0, "AdditionalPatientHistory", "X"),
    (0x0010, 0x4000, "PatientComments", "X"),
    (0x0020, 0x0010, "StudyID", "Z"),
    (0x0020, 0x4000, "ImageComments", "X"),
    (0x0032, 0x1032, "RequestingPhysician", "X"),
    (0x0038, 0x0010, "AdmissionID", "X"),
    (0x0038, 0x0500, "PatientState", "X"),
    (0x0040, 0x0006, "ScheduledPerformingPhysicianName", "X"),
    (0x0040, 0x0244, "PerformedProcedureStepStartDate", "X"),
    (0x0040, 0x0245, "PerformedProcedureStepStartTime", "X"),
    (0x0040, 0x0253, "PerformedProcedureStepID", "X"),
    (0x0040, 0x1001, "RequestedProcedureID", "X"),
    (0x0040, 0x2016, "PlacerOrderNumberImagingServiceRequest", "Z"),
    (0x0040, 0x2017, "FillerOrderNumberImagingServiceRequest", "Z"),
    (0x0040, 0xA730, "ContentSequence", "X"),
    (0x0088, 0x0140, "StorageMediaFileSetUID", "U"),
    (0x3006, 0x0024, "ReferencedFrameOfReferenceUID", "U"),
    (0x3006, 0x00C2, "RelatedFrameOfReferenceUID", "U"),
]
CRITICAL_TAGS = ["PatientName", "PatientID", "PatientBirthDate", "AccessionNumber", "InstitutionName", "ReferringPhysicianName", "OtherPatientIDs"]
VENDOR_PHI_TAGS: list[tuple[int, int, str]] = [
    (0x0043, 0x1029, "GE"),
    (0x0019, 0x100C, "Siemens"),
    (0x0019, 0x100D, "Siemens"),
    (0x2001, 0x1003, "Philips"),
    (0x2005, 0x100E, "Philips"),
    (0x7053, 0x1000, "Toshiba"),
]
FREE_TEXT_TAGS: list[tuple[int, int, str]] = [
    (0x0008, 0x1030, "StudyDescription"),
    (0x0008, 0x103E, "SeriesDescription"),
    (0x0008, 0x4000, "IdentifyingComments"),
    (0x0010, 0x21B0, "AdditionalPatientHistory"),
    (0x0010, 0x4000, "PatientComments"),
    (0x0010, 0x2180, "Occupation"),
    (0x0018, 0x1030, "ProtocolName"),
    (0x0020, 0x4000, "ImageComments"),
    (0x0032, 0x4000, "StudyComments"),
    (0x0038, 0x4000, "VisitComments"),
    (0x0040, 0x0254, "PerformedProcedureStepDescription"),
]
# --- fixed values: patterns of protected health information in text ---
PHI_PATTERNS: list[tuple[str, str]] = [
    ("ssn", r"\b\d{3}[-.]?\d{2}[-.]?\d{4}\b"),
    ("mrn", r"\b\d{6,10}\b"),
    ("date_mdy", r"\b(0[1-9]|1[0-2])[/-](0[1-9]|[12]\d|3[01])[/-](19|20)\d{2}\b"),
    ("date_ymd", r"\b(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\b"),
    ("name", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"),
    ("address", r"\b\d{1,5}\s+[A-Z][a-z]+\s+(St|Ave|Blvd|Dr|Rd|Ln|Way|Ct)\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"\b\(\d{3}\)\s?\d{3}[-.]?\d{4}\b"),
]
HEAD_PARTS = ["HEAD", "BRAIN", "SKULL", "FACE", "SINUS", "ORBIT", "NECK", "C-SPINE", "CSPINE", "HEADNECK", "HEAD_NECK"]
HEAD_WORDS = ["HEAD", "BRAIN", "SKULL", "FACE", "SINUS"]
VOLUME_MODALITIES = ["CT", "MR", "MRI", "PT", "PET"]
# --- fixed values: creators of private blocks that are kept ---
SAFE_CREATORS = [
    "GEMS_ACQU_01", "GEMS_IDEN_01", "GEMS_IMAG_01", "GEMS_IMPS_01", "GEMS_PARM_01",
    "GEMS_PATI_01", "GEMS_RELA_01", "GEMS_SERS_01", "GEMS_STDY_01", "GEMS_HELIOS_01",
    "GEMS_CT_VES_01", "GEMS_GNHD_01", "GEMS_PETD_01", "GEMS_SHIM_01", "GEMS_ATCL_01",
    "GEMS_3DSTATE_001", "GEMS_GDXE_FALCON_04", "GEMS_FALCON_03",
    "SIEMENS CSA HEADER", "SIEMENS CSA NON-IMAGE", "SIEMENS MED DISPLAY",
    "SIEMENS MR HEADER", "SIEMENS MR SDS 01", "SIEMENS MR SDI 02",
    "SIEMENS MED SP DXMG WH AWS 1", "SIEMENS MED MG", "SIEMENS Ultrasound SC2000",
    "Philips Imaging DD 001", "Philips Imaging DD 002", "Philips MR Imaging DD 001",
    "Philips MR Imaging DD 005", "PHILIPS MR/PART", "PHILIPS IMAGING DD 001",
    "Philips US Imaging DD 033", "Philips US Imaging DD 023",
]
# --- fixed values: labels by part of a file's name, first match wins ---
NAME_RULES: list[tuple[str, str, str]] = [
    ("bad_magic", "malformed_header", "block"),
    ("deep_nesting", "nesting_bomb", "block"),
    ("length_bomb", "length_bomb", "block"),
    ("pixel_decompress", "decompression_bomb", "block"),
    ("pixel_dimension", "dimension_bomb", "block"),
    ("polyglot", "polyglot", "block"),
    ("private_payload", "private_payload", "block"),
    ("high_entropy", "preamble_anomaly", "warn"),
    ("deflated", "codec_exposure", "warn"),
    ("htj2k", "codec_exposure", "warn"),
    ("jpip", "codec_exposure", "warn"),
    ("video_", "codec_exposure", "warn"),
]
# --- fixed values: severities in rising order, verdicts with their trust ---
SEVERITIES = ["pass", "info", "warn", "fail", "critical"]
VERDICTS = [("CRITICAL", 0.0), ("FAIL", 0.2), ("SUSPICIOUS", 0.4), ("CAUTION", 0.7), ("CLEAN", 1.0)]
# --- fixed values: thresholds ---
PREAMBLE_ENTROPY = 4.0
PAYLOAD_ENTROPY, PAYLOAD_MIN, PAYLOAD_OPAQUE_MIN, WINDOW = 7.0, 8, 256, 4096
MAX_ELEMENTS, MAX_DEPTH, DEPTH_CAP = 50_000, 10, 256
FRAME_CAP, AMPLIFICATION_FLOOR, AMPLIFICATION_BLOCK, AMPLIFICATION_WARN = 1024**3, 256 * 1024**2, 1000, 100
# --- fixed values: what decoders under a sanitizer print for failed allocations and for memory faults ---
ALLOCATION_MESSAGES = ["allocation-size-too-big", "exceeds maximum supported size", "out-of-memory", "requested allocation size", "hard rss limit", r"Image size \(\d+ pixels\) exceeds"]
MEMORY_FAULTS = (
    "heap-buffer-overflow stack-buffer-overflow heap-use-after-free global-buffer-overflow use-after-free dynamic-stack-buffer-overflow SEGV FPE alloc-dealloc-mismatch negative-size-param"
).split()
