"""Names of Universal Dependencies treebanks by their file names, for links to a treebank search."""

from __future__ import annotations

import json
import re

#: code:language:treebanks
_KNOWN = (
    "ab:Abkhaz:AbNC abq:Abaza:ATB af:Afrikaans:AfriBooms aii:Assyrian:AS ajp:South_Levantine_Arabic:MADAR akk:Akkadian:PISANDUB,RIAO aln:Gheg:GPS "
    "am:Amharic:ATT apu:Apurina:UFPA aqz:Akuntsu:TuDeT ar:Arabic:NYUAD,PADT,PUD arr:Karo:TuDeT az:Azerbaijani:TueCL azz:Highland_Puebla_Nahuatl:ITML "
    "bar:Bavarian:MaiBaam be:Belarusian:HSE bej:Beja:Autogramm bg:Bulgarian:BTB bho:Bhojpuri:BHTB bm:Bambara:CRB bn:Bengali:BRU bor:Bororo:BDT "
    "br:Breton:KEB bxr:Buryat:BDT ca:Catalan:AnCora ceb:Cebuano:GJA ckt:Chukchi:HSE cop:Coptic:Scriptorium cpg:Cappadocian:AMGiC,TueCL "
    "cs:Czech:CAC,CLTT,FicTree,PDT,Poetry,PUD cu:Old_Church_Slavonic:PROIEL cy:Welsh:CCG da:Danish:DDT de:German:GSD,HDT,LIT,PUD egy:Egyptian:UJaen "
    "el:Greek:GDT,GUD eme:Teko:TuDeT en:English:Atis,CTeTex,ESLSpok,EWT,GENTLE,GUM,GUMReddit,LinES,ParTUT,Pronouns,PUD es:Spanish:AnCora,COSER,GSD,PUD "
    "ess:Yupik:SLI et:Estonian:EDT,EWT eu:Basque:BDT fa:Persian:PerDT,Seraji fi:Finnish:FTB,OOD,PUD,TDT fo:Faroese:FarPaHC,OFT "
    "fr:French:FQB,GSD,ParisStories,ParTUT,PUD,Rhapsodie,Sequoia frm:Middle_French:PROFITEROLE fro:Old_French:PROFITEROLE ga:Irish:Cadhan,IDT,TwittIrish "
    "gd:Scottish_Gaelic:ARCOSG gl:Galician:CTG,PUD,TreeGal gn:Guarani:OldTuDeT got:Gothic:PROIEL grc:Ancient_Greek:Perseus,PROIEL,PTNK gsw:Swiss_German:UZH "
    "gu:Gujarati:GujTB gub:Guajajara:TuDeT gun:Mbya_Guarani:Dooley,Thomas gv:Manx:Cadhan gwi:Gwichin:TueCL gya:Northwest_Gbaya:Autogramm "
    "ha:Hausa:NorthernAutogramm,SouthernAutogramm hbo:Ancient_Hebrew:PTNK he:Hebrew:HTB,IAHLTknesset,IAHLTwiki hi:Hindi:HDTB,PUD hit:Hittite:HitTB "
    "hr:Croatian:SET hsb:Upper_Sorbian:UFAL ht:Haitian_Creole:Autogramm hu:Hungarian:Szeged hy:Armenian:ArmTDP,BSUT hyw:Western_Armenian:ArmTDP "
    "id:Indonesian:CSUI,GSD,PUD is:Icelandic:GC,IcePaHC,Modern,PUD it:Italian:ISDT,MarkIT,Old,ParlaMint,ParTUT,PoSTWITA,PUD,TWITTIRO,Valico,VIT "
    "ja:Japanese:BCCWJ,BCCWJLUW,GSD,GSDLUW,PUD,PUDLUW jaa:Madi:Jarawara jv:Javanese:CSUI ka:Georgian:GLC kfm:Khunsari:AHA kk:Kazakh:KTB kmr:Kurmanji:MG "
    "ko:Korean:GSD,Kaist,KSL,PUD koi:Komi_Permyak:UH kpv:Komi_Zyrian:IKDP,Lattice krl:Karelian:KKPP ky:Kyrgyz:KTMU,TueCL "
    "la:Latin:CIRCSE,ITTB,LLCT,Perseus,PROIEL,UDante lb:Luxembourgish:LuxBank lij:Ligurian:GLT lt:Lithuanian:ALKSNIS,HSE ltg:Latgalian:Cairo "
    "lv:Latvian:Cairo,LVTB lzh:Classical_Chinese:Kyoto,TueCL mdf:Moksha:JR mk:Macedonian:MTB ml:Malayalam:UFAL mpu:Makurap:TuDeT mr:Marathi:UFAL "
    "mt:Maltese:MUDT myu:Munduruku:TuDeT myv:Erzya:JR nap:Neapolitan:RB nds:Low_Saxon:LSDC nhi:Western_Sierra_Puebla_Nahuatl:ITML "
    "nl:Dutch:Alpino,LassySmall no:Norwegian:Bokmaal,Nynorsk nyq:Nayini:AHA olo:Livvi:KKPP orv:Old_East_Slavic:Birchbark,RNC,Ruthenian,TOROT "
    "ota:Ottoman_Turkish:BOUN,DUDU otk:Old_Turkish:Clausal pad:Paumari:TueCL pay:Pesh:ChibErgIS pcm:Naija:NSC pl:Polish:LFG,PDB,PUD ps:Pashto:Sikaram "
    "pt:Portuguese:Bosque,CINTIL,DANTEStocks,GSD,PetroGold,Porttinari,PUD qaf:Maghrebi_Arabic_French:Arabizi qfn:Frisian_Dutch:Fame qpm:Pomak:Philotis "
    "qtd:Turkish_German:SAGT qte:Telugu_English:TECT quc:Kiche:IU ro:Romanian:ArT,Nonstandard,RRT,SiMoNERo,TueCL ru:Russian:GSD,Poetry,PUD,SynTagRus,Taiga "
    "sa:Sanskrit:UFAL,Vedic sah:Yakut:YKTDT say:Zaar:Autogramm sga:Old_Irish:DipSGG,DipWBG si:Sinhala:STB sjo:Xibe:XDT sk:Slovak:SNK sl:Slovenian:SSJ,SST "
    "sme:North_Sami:Giella sms:Skolt_Sami:Giellagas soj:Soi:AHA sq:Albanian:STAF,TSA sr:Serbian:SET ssp:Spanish_Sign_Language:LSE "
    "sv:Swedish:LinES,PUD,Talbanken swl:Swedish_Sign_Language:SSLC ta:Tamil:MWTT,TTB te:Telugu:MTG th:Thai:PUD tl:Tagalog:TRG,Ugnayan tn:Tswana:Popapolelo "
    "tpn:Tupinamba:TuDeT tr:Turkish:Atis,BOUN,FrameNet,GB,IMST,Kenet,Penn,PUD,Tourism tt:Tatar:NMCTT ug:Uyghur:UDT uk:Ukrainian:IU,ParlaMint ur:Urdu:UDTB "
    "urb:Kaapor:TuDeT uz:Uzbek:UT vep:Veps:VWT vi:Vietnamese:TueCL,VTB wbp:Warlpiri:UFAL wo:Wolof:WTB xav:Xavante:XDT xcl:Classical_Armenian:CAVaL "
    "xnr:Kangri:KDTB xpg:Phrygian:KUL xum:Umbrian:IKUVINA yo:Yoruba:YTB yrl:Nheengatu:CompLin yue:Cantonese:HK "
    "zh:Chinese:Beginner,CFL,GSD,GSDSimp,HK,PatentChar,PUD "
)
TREEBANKS = {(c, t.lower()): f"UD_{language}-{t}" for c, language, ts in (x.split(":") for x in _KNOWN.split()) for t in ts.split(",")}


def corpus_name(path: str, version: str = "", mapping: str | None = None) -> str | None:
    """UD_French-GSD for fr_gsd-ud-dev.conllu, with @ and the version if one is given; None if the treebank isn't known.

    mapping: a JSON file {language code: {treebank code: name}} that adds to the names known here.
    """
    found = re.match(r"([^_/]+)_([^_/-]+)[^/]*$", path.rstrip("/").rsplit("/", 1)[-1])
    if not found:
        return None
    known = dict(TREEBANKS)
    if mapping:
        with open(mapping, encoding="utf-8") as f:
            known.update({(c, t.lower()): name for c, ts in json.load(f).items() for t, name in ts.items()})
    name = known.get((found[1], found[2].lower()))
    return f"{name}@{version}" if name and version else name
