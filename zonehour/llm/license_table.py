"""Digests of the canonical whole texts of long licences, and notice lines by SPDX id and by name.

``python -m zonehour.llm.license_table FOLDER`` prints DIGESTS from a folder of licence texts named as in
/usr/share/common-licenses, and the ids of SPDX_IDS where the package ``packaging`` is installed.
"""

import re
import sys
from pathlib import Path

#: Licence id of each file of the folder.
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2",
    "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0",
    "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
#: Addresses that copies of the GNU licences give for the foundation; the last ones give none.
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
             "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA",
             "675 Mass Ave, Cambridge, MA 02139, USA", "https://fsf.org/", ""]
ADDRESS = re.compile(r"(?:51\s+Franklin|59\s+Temple|675\s+Mass)[^<>]*?USA\.?")
END = re.compile(r"END OF TERMS AND CONDITIONS")

#: Names of licences in notices, the first part of a line as in NOTICES before them.
NAMES = {
    "MIT": ["MIT License", "MIT"], "ISC": ["ISC License"], "Zlib": ["zlib License"], "Unlicense": ["Unlicense"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "Artistic-2.0": ["Artistic License 2.0"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
}
for _kind, _title, _versions in (
        ("GPL", "GNU General Public License", "1.0 2.0 3.0"), ("LGPL", "GNU Lesser General Public License", "2.1 3.0"),
        ("LGPL", "GNU Library General Public License", "2.0"), ("AGPL", "GNU Affero General Public License", "3.0"),
        ("GFDL", "GNU Free Documentation License", "1.1 1.2 1.3")):
    for _full in _versions.split():
        _each = {_full, _full.removesuffix(".0")}
        _forms = [f"{t}{sep}{v}" for v in _each for t, seps in ((_title, (", version ", " version ", " v", " ")), (_kind, ("-", " ", "v", " v")))
                  for sep in seps]
        NAMES.setdefault(f"{_kind}-{_full}", []).extend(_forms)
        NAMES.setdefault(f"{_kind}-{_full}-or-later", []).extend(
            f + later for f in _forms for later in (" or later", " or any later version", ", or (at your option) any later version"))
for _code, _words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
                      ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                      ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v, _where in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _long = [f"{_words} {_v}", f"{_words} {_v} {_where}"]
        NAMES[f"CC-{_code}-{_v}"] = [f"CC {_code} {_v}", f"CC {_code} {_v} License"] + [
            f"Creative Commons {x}{end}" for x in _long for end in ("", " License")]
NOTICES = [f"{what}{how} under {the}" for what in ("", "This work is ", "This project is ", "This software is ", "This program is ", "This file is ")
           for how in ("licensed", "released", "distributed") for the in ("", "the ", "a ", "the terms of the ")]


def own_id(spdx: str) -> str:
    """The id that the scan gives: GNU licences that say '-only' go by the plain id, as their whole texts do."""
    return re.sub(r"\+\Z", "-or-later", spdx.removesuffix("-only"))


def notice_lines() -> list[tuple[str, str]]:
    """(licence id, line): SPDX lines of all ids, and notices by name."""
    lines = [(own_id(i), f"SPDX-License-Identifier: {i}") for i in SPDX_IDS]
    return lines + [(i, f"{start}{name}") for i, names in NAMES.items() for name in names for start in NOTICES]


def forms_of(text: str) -> list[str]:
    """A licence's text as it is found: with each address of the foundation, with and without the part after its terms."""
    texts = {ADDRESS.sub(a, text) for a in ADDRESSES} | {text}
    return sorted(texts | {t[:END.search(t).end()] for t in texts if END.search(t)} | {t[:END.search(t).start()] for t in texts if END.search(t)})


def digests_of(folder: str) -> dict[str, str]:
    """Hexadecimal digest: licence id, of all files of the folder."""
    from . import licenses

    return {licenses.text_digest(form).hex(): own for name, own in sorted(FILES.items())
            for form in forms_of(Path(folder, name).read_text())}


# Fixed values, printed by this module.
SPDX_IDS = """
0BSD 3D-Slicer-1.0 AAL ADSL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0
AGPL-3.0-only AGPL-3.0-or-later AMD-newlib AMDPLPA AML AML-glslang AMPAS ANTLR-PD ANTLR-PD-fallback APAFML APL-1.0
APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 ASWF-Digital-Assets-1.0 ASWF-Digital-Assets-1.1 Abstyles AdaCore-doc Adobe-2006
Adobe-Display-PostScript Adobe-Glyph Adobe-Utopia Afmparse Aladdin Apache-1.0 Apache-1.1 Apache-2.0 App-s2p
Arphic-1999 Artistic-1.0 Artistic-1.0-Perl Artistic-1.0-cl8 Artistic-2.0 Artistic-dist Aspell-RU BSD-1-Clause
BSD-2-Clause BSD-2-Clause-Darwin BSD-2-Clause-FreeBSD BSD-2-Clause-NetBSD BSD-2-Clause-Patent BSD-2-Clause-Views
BSD-2-Clause-first-lines BSD-2-Clause-pkgconf-disclaimer BSD-3-Clause BSD-3-Clause-Attribution BSD-3-Clause-Clear
BSD-3-Clause-HP BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-3-Clause-No-Military-License
BSD-3-Clause-No-Nuclear-License BSD-3-Clause-No-Nuclear-License-2014 BSD-3-Clause-No-Nuclear-Warranty
BSD-3-Clause-Open-MPI BSD-3-Clause-Sun BSD-3-Clause-acpica BSD-3-Clause-flex BSD-4-Clause BSD-4-Clause-Shortened
BSD-4-Clause-UC BSD-4.3RENO BSD-4.3TAHOE BSD-Advertising-Acknowledgement BSD-Attribution-HPND-disclaimer
BSD-Inferno-Nettverk BSD-Protection BSD-Source-Code BSD-Source-beginning-file BSD-Systemics BSD-Systemics-W3Works
BSL-1.0 BUSL-1.1 Baekmuk Bahyph Barr Beerware BitTorrent-1.0 BitTorrent-1.1 Bitstream-Charter Bitstream-Vera
BlueOak-1.0.0 Boehm-GC Boehm-GC-without-fee Borceux Brian-Gladman-2-Clause Brian-Gladman-3-Clause C-UDA-1.0 CAL-1.0
CAL-1.0-Combined-Work-Exception CATOSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-2.5-AU CC-BY-3.0 CC-BY-3.0-AT
CC-BY-3.0-AU CC-BY-3.0-DE CC-BY-3.0-IGO CC-BY-3.0-NL CC-BY-3.0-US CC-BY-4.0 CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5
CC-BY-NC-3.0 CC-BY-NC-3.0-DE CC-BY-NC-4.0 CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5 CC-BY-NC-ND-3.0
CC-BY-NC-ND-3.0-DE CC-BY-NC-ND-3.0-IGO CC-BY-NC-ND-4.0 CC-BY-NC-SA-1.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.0-DE
CC-BY-NC-SA-2.0-FR CC-BY-NC-SA-2.0-UK CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0 CC-BY-NC-SA-3.0-DE CC-BY-NC-SA-3.0-IGO
CC-BY-NC-SA-4.0 CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 CC-BY-ND-3.0-DE CC-BY-ND-4.0 CC-BY-SA-1.0
CC-BY-SA-2.0 CC-BY-SA-2.0-UK CC-BY-SA-2.1-JP CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-3.0-AT CC-BY-SA-3.0-DE
CC-BY-SA-3.0-IGO CC-BY-SA-4.0 CC-PDDC CC-PDM-1.0 CC-SA-1.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CDL-1.0 CDLA-Permissive-1.0
CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-1.0 CECILL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CERN-OHL-1.1
CERN-OHL-1.2 CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 CFITSIO CMU-Mach CMU-Mach-nodoc CNRI-Jython CNRI-Python
CNRI-Python-GPL-Compatible COIL-1.0 CPAL-1.0 CPL-1.0 CPOL-1.02 CUA-OPL-1.0 Caldera Caldera-no-preamble Catharon
ClArtistic Clips Community-Spec-1.0 Condor-1.1 Cornell-Lossless-JPEG Cronyx Crossword CryptoSwift CrystalStacker Cube
D-FSL-1.0 DEC-3-Clause DL-DE-BY-2.0 DL-DE-ZERO-2.0 DOC DRL-1.0 DRL-1.1 DSDP DocBook-DTD DocBook-Schema
DocBook-Stylesheet DocBook-XML Dotseqn ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0 EPICS EPL-1.0 EPL-2.0 EUDatagrid EUPL-1.0
EUPL-1.1 EUPL-1.2 Elastic-2.0 Entessa ErlPL-1.1 Eurosym FBM FDK-AAC FSFAP FSFAP-no-warranty-disclaimer FSFUL FSFULLR
FSFULLRSD FSFULLRWD FSL-1.1-ALv2 FSL-1.1-MIT FTL Fair Ferguson-Twofish Frameworx-1.0 FreeBSD-DOC FreeImage Furuseth
GCR-docs GD GFDL-1.1 GFDL-1.1-invariants-only GFDL-1.1-invariants-or-later GFDL-1.1-no-invariants-only
GFDL-1.1-no-invariants-or-later GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2 GFDL-1.2-invariants-only
GFDL-1.2-invariants-or-later GFDL-1.2-no-invariants-only GFDL-1.2-no-invariants-or-later GFDL-1.2-only
GFDL-1.2-or-later GFDL-1.3 GFDL-1.3-invariants-only GFDL-1.3-invariants-or-later GFDL-1.3-no-invariants-only
GFDL-1.3-no-invariants-or-later GFDL-1.3-only GFDL-1.3-or-later GL2PS GLWTPL GPL-1.0 GPL-1.0+ GPL-1.0-only
GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-2.0-with-GCC-exception
GPL-2.0-with-autoconf-exception GPL-2.0-with-bison-exception GPL-2.0-with-classpath-exception
GPL-2.0-with-font-exception GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later GPL-3.0-with-GCC-exception
GPL-3.0-with-autoconf-exception Game-Programming-Gems Giftware Glide Glulxe Graphics-Gems Gutmann HDF5 HIDAPI HP-1986
HP-1989 HPND HPND-DEC HPND-Fenneberg-Livingston HPND-INRIA-IMAG HPND-Intel HPND-Kevlin-Henney HPND-MIT-disclaimer
HPND-Markus-Kuhn HPND-Netrek HPND-Pbmplus HPND-UC HPND-UC-export-US HPND-doc HPND-doc-sell HPND-export-US
HPND-export-US-acknowledgement HPND-export-US-modify HPND-export2-US HPND-merchantability-variant
HPND-sell-MIT-disclaimer-xserver HPND-sell-regexpr HPND-sell-variant HPND-sell-variant-MIT-disclaimer
HPND-sell-variant-MIT-disclaimer-rev HTMLTIDY HaskellReport Hippocratic-2.1 IBM-pibs ICU IEC-Code-Components-EULA IJG
IJG-short IPA IPL-1.0 ISC ISC-Veillard ImageMagick Imlib2 Info-ZIP Inner-Net-2.0 InnoSetup Intel Intel-ACPI
Interbase-1.0 JPL-image JPNIC JSON Jam JasPer-2.0 Kastrup Kazlib Knuth-CTAN LAL-1.2 LAL-1.3 LGPL-2.0 LGPL-2.0+
LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only
LGPL-3.0-or-later LGPLLR LOOP LPD-document LPL-1.0 LPL-1.02 LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a LPPL-1.3c
LZMA-SDK-9.11-to-9.20 LZMA-SDK-9.22 Latex2e Latex2e-translated-notice Leptonica LiLiQ-P-1.1 LiLiQ-R-1.1
LiLiQ-Rplus-1.1 Libpng Linux-OpenIB Linux-man-pages-1-para Linux-man-pages-copyleft Linux-man-pages-copyleft-2-para
Linux-man-pages-copyleft-var Lucida-Bitmap-Fonts MIPS MIT MIT-0 MIT-CMU MIT-Click MIT-Festival MIT-Khronos-old
MIT-Modern-Variant MIT-Wu MIT-advertising MIT-enna MIT-feh MIT-open-group MIT-testregex MITNFA MMIXware MPEG-SSG
MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-LPL MS-PL MS-RL MTLL Mackerras-3-Clause
Mackerras-3-Clause-acknowledgment MakeIndex Martin-Birgmeier McPhee-slideshow Minpack MirOS Motosoto MulanPSL-1.0
MulanPSL-2.0 Multics Mup NAIST-2003 NASA-1.3 NBPL-1.0 NCBI-PD NCGL-UK-2.0 NCL NCSA NGPL NICTA-1.0 NIST-PD
NIST-PD-fallback NIST-Software NLOD-1.0 NLOD-2.0 NLPL NOSL NPL-1.0 NPL-1.1 NPOSL-3.0 NRL NTIA-PD NTP NTP-0 Naumen
Net-SNMP NetCDF Newsletr Nokia Noweb Nunit O-UDA-1.0 OAR OCCT-PL OCLC-2.0 ODC-By-1.0 ODbL-1.0 OFFIS OFL-1.0
OFL-1.0-RFN OFL-1.0-no-RFN OFL-1.1 OFL-1.1-RFN OFL-1.1-no-RFN OGC-1.0 OGDL-Taiwan-1.0 OGL-Canada-2.0 OGL-UK-1.0
OGL-UK-2.0 OGL-UK-3.0 OGTSL OLDAP-1.1 OLDAP-1.2 OLDAP-1.3 OLDAP-1.4 OLDAP-2.0 OLDAP-2.0.1 OLDAP-2.1 OLDAP-2.2
OLDAP-2.2.1 OLDAP-2.2.2 OLDAP-2.3 OLDAP-2.4 OLDAP-2.5 OLDAP-2.6 OLDAP-2.7 OLDAP-2.8 OLFL-1.3 OML OPL-1.0 OPL-UK-3.0
OPUBL-1.0 OSET-PL-2.1 OSL-1.0 OSL-1.1 OSL-2.0 OSL-2.1 OSL-3.0 OpenPBS-2.3 OpenSSL OpenSSL-standalone OpenVision PADL
PDDL-1.0 PHP-3.0 PHP-3.01 PPL PSF-2.0 Parity-6.0.0 Parity-7.0.0 Pixar Plexus PolyForm-Noncommercial-1.0.0
PolyForm-Small-Business-1.0.0 PostgreSQL Python-2.0 Python-2.0.1 QPL-1.0 QPL-1.0-INRIA-2004 Qhull RHeCos-1.1 RPL-1.1
RPL-1.5 RPSL-1.0 RSA-MD RSCPL Rdisc Ruby Ruby-pty SAX-PD SAX-PD-2.0 SCEA SGI-B-1.0 SGI-B-1.1 SGI-B-2.0 SGI-OpenGL SGP4
SHL-0.5 SHL-0.51 SISSL SISSL-1.2 SL SMAIL-GPL SMLNJ SMPPL SNIA SOFA SPL-1.0 SSH-OpenSSH SSH-short SSLeay-standalone
SSPL-1.0 SUL-1.0 SWL Saxpath SchemeReport Sendmail Sendmail-8.23 Sendmail-Open-Source-1.1 SimPL-2.0 Sleepycat Soundex
Spencer-86 Spencer-94 Spencer-99 StandardML-NJ SugarCRM-1.1.3 Sun-PPP Sun-PPP-2000 SunPro Symlinks TAPR-OHL-1.0 TCL
TCP-wrappers TGPPL-1.0 TMate TORQUE-1.1 TOSL TPDL TPL-1.0 TTWL TTYP0 TU-Berlin-1.0 TU-Berlin-2.0 TermReadKey ThirdEye
TrustedQSL UCAR UCL-1.0 UMich-Merit UPL-1.0 URT-RLE Ubuntu-font-1.0 Unicode-3.0 Unicode-DFS-2015 Unicode-DFS-2016
Unicode-TOU UnixCrypt Unlicense Unlicense-libtelnet Unlicense-libwhirlpool VOSTROM VSL-1.0 Vim W3C W3C-19980720
W3C-20150513 WTFPL Watcom-1.0 Widget-Workshop Wsuipa X11 X11-distribute-modifications-variant X11-swapped XFree86-1.1
XSkat Xdebug-1.03 Xerox Xfig Xnet YPL-1.0 YPL-1.1 ZPL-1.1 ZPL-2.0 ZPL-2.1 Zed Zeeff Zend-2.0 Zimbra-1.3 Zimbra-1.4
Zlib any-OSI any-OSI-perl-modules bcrypt-Solar-Designer blessing bzip2-1.0.5 bzip2-1.0.6 check-cvs checkmk
copyleft-next-0.3.0 copyleft-next-0.3.1 curl cve-tou diffmark dtoa dvipdfm eCos-2.0 eGenix etalab-2.0 fwlw gSOAP-1.3b
generic-xts gnuplot gtkbook hdparm iMatix jove libpng-1.6.35 libpng-2.0 libselinux-1.0 libtiff libutil-David-Nugent
lsof magaz mailprio man2html metamail mpi-permissive mpich2 mplus ngrep pkgconf pnmstitch psfrag psutils python-ldap
radvd snprintf softSurfer ssh-keyscan swrule threeparttable ulem w3m wwl wxWindows xinetd xkeyboard-config-Zinoviev
xlock xpp xzoom zlib-acknowledgement
""".split()
DIGESTS = {
    "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f": "Apache-2.0",
    "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40": "Apache-2.0",
    "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "f416312175fb5ff91a3e261e92c7c7bbb67fac12942bd339a60c8f95d1c6c974": "GFDL-1.2",
    "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60": "GFDL-1.2",
    "31d1e54824dc6954a36d4d6510f749ab693be943260bc59079362a26ad74ea17": "GFDL-1.2",
    "915561db8eb69b9193eeb710593d298365e0c52787feb731c684977d5b417af7": "GFDL-1.2",
    "774142f7f9d180b719ac1fe23dfba3589d91276d948e4dd116cb8811cec60691": "GFDL-1.2",
    "32fdfe0c1e84c6861195d97de8bfddfa0467bf56100ba5330be05d21042a5d38": "GFDL-1.2",
    "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826": "GFDL-1.3",
    "37a8d6ceffb74a4cd60be1028e4d7d9cc0b1682c4aa3c1d9efd628dc5460f60b": "GPL-1.0",
    "9679cb8f8a7c25e849b925136d793d1bec010b8b9270e6ba898e2cefcb3e1f6d": "GPL-1.0",
    "6c4bc98bd65d3fcebacd77b2870f9cc296f9bf4add0e7baf975b6d183f211e86": "GPL-1.0",
    "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70": "GPL-1.0",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "6ca08526ee81355436001f14a8806abe1b624bd69c193bcb74e2abc8e629ade5": "GPL-1.0",
    "efcbd5d5f621ec465277efcb03890a7fae6d9253e17b05ef7d7c6f90729a0fc9": "GPL-1.0",
    "858bb219a7a780439b4bc4b70a09728cb4a536c4609a75c282fdaf69c8a85201": "GPL-1.0",
    "71fa4bd5fde166ce4fa896f8698e1bcf77024e8a262598b2ea4d3bcad7b6812f": "GPL-1.0",
    "98c96304603be152968c123e484f744c9b51ebd341914aee6eea5c39133891e1": "GPL-1.0",
    "ac9f80a0d38a1e001427acb1e9fa5f9a23aee35e40ee2759901306fd4e382697": "GPL-1.0",
    "a87d2335c7c408f93c15dd6892a723a61b2645ff1ad65619233239cce6bd570d": "GPL-1.0",
    "c0734228e33375b72256fed50d8056b50049dff71f408765af98cd4384a7434a": "GPL-1.0",
    "7b86297a2762700b078231c8b488809b0f63cac5e298d74f4270d251bbef230f": "GPL-1.0",
    "2360a1b8fc5b5a8b1db5f560a193fbbc23ee8a553de375a1c8fcc5805d683848": "GPL-1.0",
    "49c28d1fc102fb3e0acfa3ce095cfbf3708b6d74fe56f4f5a5c7895ccab7db2d": "GPL-1.0",
    "b1760bf307390061742600594a54c5dd007242ae734df09d72d1086b3b16b1fd": "GPL-1.0",
    "966343c399567c0324225524825ace9723f53b791f22fa0979404acebbfa0cbb": "GPL-1.0",
    "f1412332f5361d2a392bb637c3844ed3a32b7d701ac0e7abacce50b34a9a3afb": "GPL-2.0",
    "34cacbc5d4c8288f220e8dfade5276e6f76704f67150b4388c9ed3e3ff88cd90": "GPL-2.0",
    "17bc27c667a8d82915bb74a167975daaa34a72ef983dffc60903e06b043338ba": "GPL-2.0",
    "d111d1c24a44c987fb91de3ce5aab3ec35d8061a2c8a41ffaa8bb64c47df6960": "GPL-2.0",
    "2abe4f2f5ebff4aa8ed567a0cea0b9820cd074d9d7eda91d90df08701b51faa2": "GPL-2.0",
    "3f6302b11b06e2ba13b2ac80ac77a1979662ab69ce0b459e03a0238dd35d3518": "GPL-2.0",
    "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808": "GPL-2.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "78e9c9f811bd1ba04ed6d619d3e51a759305d2f124cee9defa3535ba4a24bd25": "GPL-2.0",
    "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774": "GPL-2.0",
    "58f387b55eb95a9c5a6ef16e9064e1bfa9420a69181c677ee6eddf6ed1397cfd": "GPL-2.0",
    "acaf68e303fe7610fff5b930bace57b87821d132bc434f4a104512da48f8bb6c": "GPL-2.0",
    "ba8b5323b72bf2f2c5d07074133b38292e0fa23fde8fa48771ba8a04cccacddd": "GPL-2.0",
    "1188bd946c8b086fe6ea384131bc5e4725728e74e0fe1902762c9c87ec4bd36a": "GPL-2.0",
    "949d7b0a70d9281ea0bb37fd8aa082f26cd4efcfbb376d0dccad043e772c09a0": "GPL-2.0",
    "71f3bc98cacf711b6e2ff997b37641e59cc5bf623e7c0f0e8343aed2626f4ec9": "GPL-2.0",
    "c8b499e4d65a0a8fb2cf7e4633b8862a03747979b29cc452c4ceaef94303cf0c": "GPL-2.0",
    "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191": "GPL-3.0",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "3c503e1843d56bee44590ba959b2a745cf954688aa5dd285043d139d8c3e6cd6": "LGPL-2.0",
    "96c47047421b3be5cae9a68c75f37fdcf07945fba0a1d6db6a3b57f9c70f75a0": "LGPL-2.0",
    "cf38cfc729861170868078065b856d3242fe7a850766def057d000a16c81b436": "LGPL-2.0",
    "2652838d994cbfd49626674c95d3dd21f6f86da9dcd7b97e2a33347147ba5323": "LGPL-2.0",
    "09bda551cd6a1058f0e9053b4e2fcc0bfb193e8bb1e1485734c5113235b4a30d": "LGPL-2.0",
    "bdb969a377f6160f4ad0ed61171a77004650a9c2517d62828be29f35b6bf6b31": "LGPL-2.0",
    "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2": "LGPL-2.0",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "dc842683831d008ff5f32600206cfd765e4d05df71fe831b1b4b31462fa2fff1": "LGPL-2.0",
    "5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b": "LGPL-2.0",
    "084782a05c82d5e85c704f06bab601971e84b3b9b90a51c95ffcff2b342d9cf2": "LGPL-2.0",
    "cbc927caf696ef44b2fbebe29ffa45a5fccf0a64c78f2b85678a11032ebb3318": "LGPL-2.0",
    "d40504a2bf1a1a86ee76e642ced31126577d21774b1ac0a222ce730ec78d7108": "LGPL-2.0",
    "feb45efa998ac9d6ca85b1b2b7dfb124a14b1e88f579d2de38fe3a7970ce7380": "LGPL-2.0",
    "f6f787a756b0ee346078680aaf1b61890be68459d8177b6c3193d90b16ffbfd5": "LGPL-2.0",
    "4267d994f8c02ca4ef8e1b0ff4cbc23bbd6e3a92e635af26765abcc108701db7": "LGPL-2.0",
    "1d825b7baf1bf65d09c6021d567702afa7274541e0c52091ae4519b9806589f2": "LGPL-2.0",
    "d00d08192018b2217de04b223449941a18a7cb07d0c025393948065a12eb0fb2": "LGPL-2.1",
    "a6742add8db4ff9ba6917da0bd1f95927436acfd65ae81933f1e9a859d38d9fa": "LGPL-2.1",
    "9862e738f315d8a5309bc010439dcb015ff90374b4007a59d5b00e12f9642e8f": "LGPL-2.1",
    "1d2a09e288311515cd0682b55db758224412a4901ca0578bf16420229d5190c4": "LGPL-2.1",
    "5c42345581e1857951a2f5c540eae7981a9540e2d41028f448a195bb48dd33f0": "LGPL-2.1",
    "e8379077377b4f1cf6d306654dca012e99fec5e9a13474071c353ba3557fc48b": "LGPL-2.1",
    "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df": "LGPL-2.1",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "df8b7d554d9ba4683d95046dc0cd8fdf6c063841a3cfabcf242ab40e69237421": "LGPL-2.1",
    "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47": "LGPL-2.1",
    "bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb": "LGPL-2.1",
    "925c28788af11361f32b5b10dbeb4454be64e8448ed4a7c0926618a5d8a85bfb": "LGPL-2.1",
    "3bde1ca18489d8594a2c0c04b5ae1003c1795d1680675f4ef758325e1e1c3169": "LGPL-2.1",
    "0de2e3ba00ed5f309ce9d71663e50ea414063f6e46865f2d80d4ad038f268c87": "LGPL-2.1",
    "4f163e21ac81a5bb5b92c19ede75a32428e1338af052850b5a7c1162f56ca800": "LGPL-2.1",
    "e8569a0bd486071c6889615f7a331a9c15914f9f684e92e729d2b90d5bed08f9": "LGPL-2.1",
    "4a911a8feec99700eb1ee1c3bcc0936274993e18aad2aef58a51b2a82419c9c6": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
}


if __name__ == "__main__":
    for _digest, _name in digests_of(sys.argv[1]).items():
        print(_digest, _name)
    try:
        from packaging.licenses._spdx import LICENSES
    except ModuleNotFoundError:
        pass
    else:
        print(*sorted(x["id"] for x in LICENSES.values()))
