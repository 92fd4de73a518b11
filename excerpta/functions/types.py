"""File types as data: categories, MIME types, extractors. One small dimension that detection joins or looks up."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_MIME = "application/octet-stream"
METADATA_ONLY = "metadata_only"

# Category members.
OFFICE = "doc dot wps wpt docx dotx dotm docm xls xlt et ett xlsb xlsx xlsm xltx xltm xlam ppt pot pps dps dpt vsd vsdx odt".split()
ARCHIVE = "zip 7z rar tar gz bz2 xz rpm iso tgz".split()
IMAGE = "png jpg jpeg bmp gif webp jpe tif tiff ico svg psd heic heif tga pcx jp2 jpx cur dds exr eps iff jpf jng mng pbm pcd pgm pnm ppm psb pxr sct wbmp xpm".split()
VIDEO = "swf mp4 mpg wmv 3g2 3gp asf avi dat dv f4v flv hevc m2ts m2v m4v mjpeg mkv mov mpeg mts mxf ogv rm rmvb vob webm wtv".split()
AUDIO = (
    "mid midi wav ogg oga ogx mp3 8svx aac ac3 aiff aif amb amr au avr caf cdda cvs cvsd cvu dts dvms fap flac fssd gsrt hcom htk ima ircam m4a m4b m4p m4r maud mmf mp2 nist opus paf pcma "
    "pcmu prc pvf ra ram sd2 sln smp snd sndr sndt sou sph spx tta txw vms voc vox w64 wma wv wve"
).split()
CODE = "go java py pyw c cpp h hpp cc cxx hh hxx js jsx tsx html htm css scss sass less php rs swift kt kts scala rb vbs pl pm sql xml json yaml yml md markdown sh bash bat ps1".split()
PLAIN = "txt log ini".split()

# MIME type of each extension, by kind of file.
MIME_DOCUMENTS = """
doc application/msword
docx application/vnd.openxmlformats-officedocument.wordprocessingml.document
xls application/vnd.ms-excel
xlt application/vnd.ms-excel
xlsb application/vnd.ms-excel.sheet.binary.macroEnabled.12
xlsx application/vnd.openxmlformats-officedocument.spreadsheetml.sheet
xltx application/vnd.openxmlformats-officedocument.spreadsheetml.template
xltm application/vnd.ms-excel.template.macroEnabled.12
xlam application/vnd.ms-excel.addin.macroEnabled.12
ppt application/vnd.ms-powerpoint
vsd application/vnd.visio
vsdx application/vnd.visio
odt application/vnd.oasis.opendocument.text
csv text/csv
in text/plain
ini text/plain
log text/plain
odp application/vnd.oasis.opendocument.presentation
ods application/vnd.oasis.opendocument.spreadsheet
ott application/vnd.oasis.opendocument.text-template
pdf application/pdf
ppsx application/vnd.openxmlformats-officedocument.presentationml.slideshow
pptx application/vnd.openxmlformats-officedocument.presentationml.presentation
rtf application/rtf
txt text/plain
"""
MIME_ARCHIVES = """
zip application/zip
7z application/x-7z-compressed
rar application/vnd.rar
tar application/x-tar
gz application/gzip
bz2 application/x-bzip2
xz application/x-xz
rpm application/x-rpm
iso application/x-iso9660-image
tgz application/x-tar-gz
tar.bz2 application/x-tar-bz2
tar.gz application/x-tar-gz
tar.xz application/x-tar-xz
zipx application/zipx
"""
MIME_IMAGES = """
png image/png
jpg image/jpeg
jpeg image/jpeg
bmp image/bmp
gif image/gif
webp image/webp
jpe image/jpeg
tif image/tiff
tiff image/tiff
ico image/x-icon
svg image/svg+xml
psd image/vnd.adobe.photoshop
heic image/heic
heif image/heif
tga image/x-tga
pcx image/x-pcx
jp2 image/jp2
jpx image/jpx
cur image/x-icon
dds image/x-dds
exr image/x-exr
eps application/postscript
iff image/x-iff
jpf image/jpx
jng image/x-jng
mng video/x-mng
pbm image/x-portable-bitmap
pcd image/x-photo-cd
pgm image/x-portable-graymap
pnm image/x-portable-anymap
ppm image/x-portable-pixmap
psb image/vnd.adobe.photoshop
pxr image/x-pixar
sct image/x-sct
wbmp image/vnd.wap.wbmp
xpm image/x-xpm
djvu image/vnd.djvu
"""
MIME_VIDEO = """
swf application/x-shockwave-flash
mp4 video/mp4
mpg video/mpeg
wmv video/x-ms-wmv
3g2 video/3gpp2
3gp video/3gpp
asf video/x-ms-asf
avi video/x-msvideo
dat video/mp2t
dv video/dv
f4v video/x-f4v
flv video/x-flv
hevc video/hevc
m2ts video/mp2t
m2v video/mpeg
m4v video/mp4
mjpeg video/mjpeg
mkv video/x-matroska
mov video/quicktime
mpeg video/mpeg
mts video/mp2t
mxf application/mxf
ogv video/ogg
rm application/vnd.rn-realmedia
rmvb application/vnd.rn-realmedia-vbr
vob video/x-ms-vob
webm video/webm
wtv video/x-ms-wtv
rp application/vnd.rn-realmedia
"""
MIME_AUDIO = """
mid audio/midi
midi audio/midi
wav audio/wav
ogg audio/ogg
oga audio/ogg
ogx audio/ogg
mp3 audio/mpeg
8svx audio/x-8svx
aac audio/aac
ac3 audio/ac3
aiff audio/aiff
aif audio/aiff
amb audio/amb
amr audio/amr
au audio/basic
avr audio/x-avr
caf audio/x-caf
cdda audio/x-cdda
cvs audio/x-cvs
cvsd audio/x-cvs
cvu audio/x-cvu
dts audio/x-dts
dvms audio/x-dvms
fap audio/x-fap
flac audio/flac
fssd audio/x-fssd
gsrt audio/x-gsrt
hcom audio/x-hcom
htk audio/x-htk
ima audio/x-ima
ircam audio/x-ircam
m4a audio/mp4
m4b audio/mp4
m4p audio/mp4
m4r audio/x-m4r
maud audio/x-maud
mmf audio/x-mmf
mp2 audio/mpeg
nist audio/x-nist
opus audio/opus
paf audio/x-paf
pcma audio/PCMA
pcmu audio/PCMU
prc audio/x-prc
pvf audio/x-pvf
ra audio/x-pn-realaudio
ram audio/x-pn-realaudio
sd2 audio/x-sd2
sln audio/x-sln
smp audio/x-smp
snd audio/basic
sndr audio/x-snd
sndt audio/x-snd
sou audio/x-sou
sph audio/x-sph
spx audio/x-speex
tta audio/x-tta
txw audio/x-txw
vms audio/x-vms
voc audio/x-voc
vox audio/x-vox
w64 audio/x-w64
wma audio/x-ms-wma
wv audio/x-wavpack
wve audio/x-wve
m3u audio/x-mpegurl
m3u8 application/vnd.apple.mpegurl
"""
MIME_CODE = """
go text/x-go
java text/x-java-source
py text/x-python
c text/x-c
cpp text/x-c++
h text/x-c
hpp text/x-c++
js application/javascript
jsx text/jsx
tsx application/typescript
html text/html
htm text/html
css text/css
php application/x-httpd-php
rs text/x-rust
swift text/x-swift
kt text/x-kotlin
rb text/x-ruby
vbs text/vbscript
sql application/sql
xml application/xml
json application/json
yaml application/x-yaml
yml application/x-yaml
md text/markdown
sh application/x-sh
bash application/x-sh
bat application/x-bat
ps1 application/x-powershell
vue text/x-vue
"""
MIME_OTHER = """
3dm model/vnd.3dm
3mf model/3mf
apk application/vnd.android.package-archive
azw3 application/vnd.amazon.ebook
blend application/x-blender
c4d application/vnd.c4d
catpart application/vnd.catia
cfg text/x-cfg
chm application/vnd.ms-htmlhelp
conf text/x-conf
config text/x-config
daf application/x-daf
dbf application/x-dbf
dcm application/dicom
def text/x-def
dll application/vnd.microsoft.portable-executable
dsm application/x-dsm
dwf model/vnd.dwf
dwg application/acad
dws application/x-dws
dxf application/dxf
dylib application/x-mach-binary
egg application/x-python-egg
eml message/rfc822
exe application/vnd.microsoft.portable-executable
f3d application/vnd.autodesk.f3d
fbx application/x-fbx
hlp application/winhlp
iges model/iges
igs model/iges
jar application/java-archive
key application/vnd.apple.keynote
list text/x-list
lrf application/x-sony-bbeb
max application/x-3ds
mht message/rfc822
mhtml message/rfc822
mscompress application/x-mscompress
numbers application/vnd.apple.numbers
obj model/obj
ofd application/vnd.ofd
pages application/vnd.apple.pages
pdb application/vnd.palm
prt application/x-prt
sldasm application/vnd.solidworks
sldprt application/vnd.solidworks
snb application/x-snb
so application/x-sharedlib
step model/step
stl application/sla
stp model/step
sys application/vnd.microsoft.portable-executable
tex application/x-tex
ts application/typescript
vcf text/vcard
whl application/x-python-wheel
x3d model/x3d+xml
x_t model/x-parasolid
xmind application/x-xmind
xpi application/x-xpinstall
xps application/vnd.ms-xpsdocument
"""
# The extension that stands for a MIME type.
EXTENSION_OF_MIME = """
audio/midi mid
audio/wav wav
audio/ogg ogg
audio/mpeg mp3
audio/x-8svx 8svx
audio/aac aac
audio/ac3 ac3
audio/aiff aiff
audio/amb amb
audio/amr amr
audio/basic au
audio/x-avr avr
audio/x-caf caf
audio/x-cdda cdda
audio/x-cvs cvs
audio/x-cvu cvu
audio/x-dts dts
audio/x-dvms dvms
audio/x-fap fap
audio/flac flac
audio/x-fssd fssd
audio/x-gsrt gsrt
audio/x-hcom hcom
audio/x-htk htk
audio/x-ima ima
audio/x-ircam ircam
audio/mp4 m4a
audio/x-m4r m4r
audio/x-maud maud
audio/x-mmf mmf
audio/x-nist nist
audio/opus opus
audio/x-paf paf
audio/PCMA pcma
audio/PCMU pcmu
audio/x-pvf pvf
audio/x-pn-realaudio ra
audio/x-sd2 sd2
audio/x-sln sln
audio/x-smp smp
audio/x-snd snd
audio/x-sou sou
audio/x-sph sph
audio/x-speex spx
audio/x-tta tta
audio/x-txw txw
audio/x-vms vms
audio/x-voc voc
audio/x-vox vox
audio/x-w64 w64
audio/x-ms-wma wma
audio/x-wavpack wv
audio/x-wve wve
video/mp4 mp4
video/3gpp 3gp
application/x-mscompress-szdd mscompress
application/winhlp hlp
"""
# Supported types that have no MIME type of their own.
NO_MIME = "cc code cxx docm dot dotm dotx dps dpt et ett hh hxx kts less markdown pgp pl pm pot potm potx pps ppsm pptm pyw sass scala scss wps wpt xlsm".split()
# Which extractor reads which types.
EXTRACTORS = {
    "doc": "doc wps wpt dot",
    "docx": "docx dotx dotm docm odt",
    "ppt": "ppt dps dpt pot pps",
    "pptx": "pptx potx potm ppsm pptm ppsx vsdx",
    "vsd": "vsd",
    "xls": "xls et ett xlt",
    "xlsx": "xlsx xlsm xltx xltm xlam",
    "xlsb": "xlsb",
    "pdf": "pdf",
    "csv": "csv",
    "rtf": "rtf",
    "pgp": "pgp",
    "archive": "zip 7z rar tar gz tgz tar.gz bz2 xz tar.bz2 tar.xz rpm iso",
}


def _pairs(*tables: str) -> dict[str, str]:
    return dict(line.split() for t in tables for line in t.strip().splitlines())


@lru_cache(1)
def mime_map() -> dict[str, str]:
    """Extension to MIME type."""
    return _pairs(MIME_DOCUMENTS, MIME_ARCHIVES, MIME_IMAGES, MIME_VIDEO, MIME_AUDIO, MIME_CODE, MIME_OTHER)


@lru_cache(1)
def extractor_map() -> dict[str, str]:
    """Type to the name of its extractor; what is not here has only metadata."""
    out = {t: name for name, types in EXTRACTORS.items() for t in types.split()}
    out |= dict.fromkeys([*PLAIN, *CODE], "text") | dict.fromkeys(IMAGE, "image")
    return out | dict.fromkeys(AUDIO, "audio") | dict.fromkeys(VIDEO, "video")


@lru_cache(1)
def supported() -> frozenset[str]:
    return frozenset(extractor_map()) | {"code", "mscompress", "hlp"}


@lru_cache(1)
def back_map() -> dict[str, str]:
    """MIME type to the extension that stands for it: audio types, and a few more."""
    return _pairs(EXTENSION_OF_MIME)


def category(extension: str) -> str:
    """office, archive, image, text, pdf or other; double extensions of archives, code and markup are other."""
    for name, members in (("office", OFFICE), ("archive", ARCHIVE), ("image", IMAGE), ("text", [*PLAIN, "text", "plain", "csv"]), ("pdf", ["pdf"])):
        if extension in members:
            return name
    return "other"


@lru_cache(1)
def rows() -> tuple[tuple[str, str, str, str, bool], ...]:
    known = sorted(set(mime_map()) | supported() | {"text", "plain"})
    return tuple((e, mime_map().get(e, DEFAULT_MIME), category(e), extractor_map().get(e, METADATA_ONLY), e in supported()) for e in known)


def type_dimension(spark: SparkSession) -> DataFrame:
    """``ext, mime, category, extractor, supported``: about 300 rows, a fixed size, safe to broadcast."""
    return spark.createDataFrame(list(rows()), "ext string, mime string, category string, extractor string, supported boolean")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    # one literal map, folded to a constant at planning
    return F.element_at(F.from_json(F.lit(json.dumps(pairs)), "map<string,string>"), key)


def mime_of(extension: Column) -> Column:
    return F.coalesce(_lookup(mime_map(), extension), F.lit(DEFAULT_MIME))


def extension_of_mime(mime: Column) -> Column:
    return F.coalesce(_lookup(back_map(), mime), F.lit(""))


def extractor_of(type_: Column) -> Column:
    return F.coalesce(_lookup(extractor_map(), type_), F.lit(METADATA_ONLY))


def category_of(extension: Column) -> Column:
    return F.coalesce(_lookup({e: c for e, _, c, _, _ in rows()}, extension), F.lit("other"))


def is_supported(type_: Column) -> Column:
    return type_.isin(*sorted(supported()))


def is_recognized(type_: Column) -> Column:
    return is_supported(type_) | (mime_of(type_) != DEFAULT_MIME)
