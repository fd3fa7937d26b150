"""The weighted lexicon of abusive, hateful and sexual language in English, German, French and Spanish, built by rules.

Word lists by language (insults, belittling adjectives, words for harm, body parts, dehumanising nouns, groups, sexual
words with their forms) are combined with frames: who is meant (you are a ..., espèce de ...), who does what to whom (I
will ... you), what should be done to people (should be ...). Weights are evidence: a passage counts from 1.0 on, so an
insult needs a second sign, a frame or an adjective, while a threat stands alone. Exceptions are phrases in which the
words are innocent; what lies inside one of them doesn't count. A leading ~ marks words that are often masked (b***h).
"""

from __future__ import annotations

from itertools import product


def each(*lists: tuple[str, ...]) -> tuple[str, ...]:
    """All phrases with one part of every list, in order; empty parts are left out."""
    return tuple(dict.fromkeys(" ".join(p for p in parts if p) for parts in product(*lists)))


def masked(text: str) -> tuple[str, ...]:
    return tuple("~" + w for w in text.split())


def listed(text: str) -> tuple[str, ...]:
    return tuple(part.strip() for part in text.split("/"))


def forms(stems: str, *endings: str) -> tuple[str, ...]:
    """Verb forms: each stem with each ending; a stem written a:b has b before a vowel."""
    out = []
    for stem in stems.split():
        plain, _, soft = stem.partition(":")
        out += ["~" + ((soft or plain) if e[:1] in "ei" else plain) + e for e in ("", *endings)]
    return tuple(dict.fromkeys(out))


# ---------------------------------------------------------------- insults and threats

INSULTS = {
    "en": masked("idiot moron imbecile cretin scumbag loser bastard bitch dipshit asshole arsehole dickhead dumbass jackass wanker twat cunt whore slut shithead douchebag dumbfuck fuckwit fucktard halfwit dimwit simpleton nitwit lowlife scum dirtbag sleazebag degenerate prick motherfucker knobhead tosser skank creep"),
    "de": masked("idiot vollidiot trottel vollpfosten schwachkopf drecksack drecksau arschloch arsch wichser schlampe hure nutte fotze mistkerl miststück dummkopf depp blödmann hohlkopf spast spasti penner versager abschaum hurensohn saftsack arschgeige flachzange hackfresse missgeburt lutscher"),
    "fr": masked("abruti abrutie crétin crétine connard connasse salaud salope salopard imbécile idiot idiote ordure débile pute putain enculé bâtard bouffon raclure minable fumier merdeux pétasse pouffiasse tocard attardé sous-merde"),
    "es": masked("idiota imbécil gilipollas cabrón cabrona desgraciado desgraciada cretino cretina pendejo pendeja capullo zorra tarado tarada puta puto estúpido estúpida subnormal mamón mierda escoria malnacido perra inútil cerdo payaso retrasado hijoputa"),
}
BELITTLING = {
    "en": listed("stupid/dumb/~fucking/filthy/dirty little/pathetic/worthless/useless/brainless/disgusting/ugly/miserable/spineless/retarded/good for nothing/lousy/revolting/hopeless/clueless/mindless/gutless"),
    "de": listed("dummer/dumme/dummes/dreckiger/dreckige/dreckiges/wertloser/wertlose/hirnloser/hirnlose/widerlicher/widerliche/verdammter/verdammte/erbärmlicher/erbärmliche/erbärmliches/nutzloser/nutzlose/elender/elende/blöder/blöde/mieser/miese/fetter/hässlicher/hässliche"),
    "fr": listed("stupide/inutile/minable/répugnant/répugnante/dégoûtant/dégoûtante/pathétique/dégueulasse/misérable/pauvre/sale/gros/grosse/lamentable/débile/putain de"),
    "es": listed("estúpido/estúpida/inútil/patético/patética/repugnante/asqueroso/asquerosa/miserable/inservible/maldito/maldita/puto/puta/despreciable/sucio/lamentable"),
}
#: Frames right before an insult that say who is meant, and frames right after one.
ADDRESS = {
    "en": listed("you/you are a/you are an/you re a/you re an/you are such a/you are such an/you are nothing but a/you are just a/you little/you absolute/you total/you complete/you bunch of/what a/what an/such a/only a/only an/what kind of/looks like a/looks like an/shut up you/listen you/hey"),
    "de": listed("du/du bist ein/du bist eine/du bist so ein/du bist so eine/ihr/sie sind ein/so ein/so eine/so einen/was für ein/was für eine/nur ein/nur eine/halts maul du/verdammter/verdammte"),
    "fr": listed("tu es un/tu es une/t es un/t es une/espèce d/espèce de/bande de/pauvre/sale/quel/quelle/seul un/seule une/vous êtes un/vous êtes des/tu n es qu un/tu n es qu une/gros"),
    "es": listed("eres un/eres una/eres/sois unos/pedazo de/qué/maldito/maldita/solo un/solo una/menudo/menuda/so/panda de/no eres más que un/no eres más que una"),
}
AFTER = {"en": listed("like you/like yourself"), "de": listed("wie dich/wie du/wie dir"), "fr": listed("comme toi/comme vous"), "es": listed("como tú/como vosotros")}

I_WILL = listed("i will/i ll/i m going to/i am going to/i m gonna/i am gonna/im gonna/we will/we ll/we are going to/gonna/someone should/somebody should/i want to/i swear i ll")
HARM = listed("kill/murder/stab/strangle/choke/shoot/beat/beat up/hurt/burn/drown/hang/rape/smash/crush/gut/slaughter/destroy/hunt down/bash/skin/bury")
PARTS = listed("face/face in/neck/throat/skull/head in/head off/teeth in/teeth out/fingers/legs/arms/knees/bones/jaw/nose/ribs/kneecaps/spine")
HURT = listed("break/smash/crush/cut/slit/bash/kick/punch/rip/snap/cave/knock/stomp")

ABUSE = {
    1.0: (
        *each(I_WILL, HARM, ("you",)),
        *each(("go", "just", "please", "you should", "why don t you", "better"), listed("kill/hang/drown/shoot/burn"), ("yourself",)), *each(listed("kill/hang/drown"), ("yourself",)),
        *each(listed("i hope/i wish/hope"), listed("you die/you d die/you drop dead/you rot/you choke/you burn/you suffer/you get cancer/your family dies/your house burns down/your house burns/your kids die")),
        *each(("the world would be", "we would all be", "everyone would be"), listed("better off/better/quieter/nicer/happier"), listed("without you/if you died/if you were dead/if you stopped breathing/if you were gone")),
        *listed("if you stopped breathing/drop dead you/you deserve to die/you should be dead/die in a fire/eat ~shit and die/i know where you live and/you piece of ~shit/you are a piece of ~shit/go to hell you/shut the ~fuck up/shut your ~fucking mouth/~fuck you/~fuck off you/go ~fuck yourself/~motherfucker/nobody likes you and nobody/you make me sick you"),
        *each(listed("ich werde dich/ich will dich/wir werden dich/man sollte dich"), listed("töten/umbringen/erschießen/erstechen/abstechen/erwürgen/verprügeln/totschlagen/fertigmachen/schlachten")),
        *each(listed("bringe/bring/bringen wir"), ("dich um",)), *each(listed("schlag/schlage/stech/steche/mach/mache"), ("dich",), listed("tot/ab/kalt/platt")),
        *each(listed("brech/breche/brechen wir/schlag/schlage"), ("ich dir", "dir"), ("die", "alle", "das"), listed("finger/beine/knochen/nase/zähne/genick/arme/rippen/fresse")),
        *each(("geh dich", "geh und", "geh"), listed("ertränken/erhängen/sterben/aufhängen/ertränk dich/häng dich auf/spring")), *listed("bring dich um/häng dich auf/ertränk dich/verreck doch/verrecke/halt dein ~maul/halt deine fresse/halt die ~fresse/halts maul/~fick dich/verpiss dich du/du stück ~scheiße/hoffentlich stirbst du/ich hoffe du stirbst"),
        *each(listed("je vais te/on va te/je veux te/je vais vous"), listed("tuer/buter/crever/frapper/casser/égorger/étrangler/massacrer/défoncer/planter/noyer/brûler/démolir")),
        *each(("te", "et te", "lui"), ("casser",), listed("les doigts/les jambes/les dents/la gueule/le nez/les os/la tête/les bras")),
        *each(("va te", "allez vous", "tu devrais te"), listed("noyer/pendre/tuer/suicider/faire ~foutre/faire enculer")), *listed("crève ~salope/espèce de ~con/gros ~con/pauvre ~con/quel ~con/tue toi/pends toi/ferme ta ~gueule/ta ~gueule/ferme la ~connard/fils de ~pute/~nique ta mère/j espère que tu vas crever/j espère que ta maison brûle/je te crève"),
        *each(listed("te voy a/te vamos a/voy a/quiero"), listed("matar/matarte/apuñalar/apuñalarte/estrangular/estrangularte/reventar/reventarte/pegar un tiro/degollar/partir la cara/romper la cara/romper los dedos/romper las piernas/quemar")),
        *each(("te", "y te"), listed("romperé/partiré/cortaré"), listed("los dedos/las piernas/la cara/el cuello/los dientes/los huesos/la nariz")),
        *listed("ahógate/ahórcate/mátate/muérete/suicídate/cierra el pico/cierra la ~puta boca/que te ~jodan/vete a la ~mierda/~hijo de ~puta/~hija de ~puta/vete al infierno/ojalá te mueras/ojalá se queme tu casa/me cago en tu madre"),
        *(phrase for lang, nouns in INSULTS.items() for phrase in (*each(ADDRESS[lang], nouns), *each(nouns, AFTER[lang]))),
    ),
    0.7: (
        *each(listed("find out/i know/know/we know"), ("where you",), listed("live/sleep/work")), *each(("and", "then", "", "will"), HURT, ("your",), PARTS),
        *listed("next time i see you/wait until i see you/shut your mouth/shut your mouth you/shut up you/nobody would miss/no one would miss/watch your back/you will regret this/you will pay for this/go to hell/you disgust me"),
        *listed("finde heraus wo du wohnst/weiß wo du wohnst/wir wissen wo du wohnst/vermisst keiner/niemand würde dich vermissen/das wirst du bereuen/pass auf dich auf du"),
        *listed("trouver où tu habites/sais où tu habites/personne ne regrettera/personne ne te regrettera/tu vas le regretter/tu vas payer"),
        *listed("averiguar dónde vives/sé dónde vives/sabemos dónde vives/nadie echará de menos/nadie te echará de menos/te vas a arrepentir/cierra la boca"),
    ),
    0.6: tuple(dict.fromkeys(noun for nouns in INSULTS.values() for noun in nouns if noun not in ("~inútil", "~creep"))),
    0.45: (*dict.fromkeys(word for words in BELITTLING.values() for word in words if word not in ("sale", "gros", "grosse", "pauvre", "sucio", "puta", "estúpido", "estúpida")), *listed("pig/swine/clown/coward/liar/vermin/schwein/sau/cochon/porc/chien/cerda/rata/everyone here knows it/everyone knows it/das weiß hier jeder/das wissen alle/alle wissen das/tout le monde le sait/todos lo saben")),
}

# ---------------------------------------------------------------- hatred of groups

DEHUMAN = {
    "en": masked("vermin subhuman subhumans parasites cockroaches rats filth scum animals savages maggots lice swine pests mongrels trash garbage") + listed("a plague/a disease/a cancer/an infestation/a stain/inferior/not human/less than human"),
    "de": masked("ungeziefer untermenschen parasiten ratten abschaum dreck tiere schmarotzer kakerlaken bestien müll pack gesindel") + listed("eine plage/eine seuche/minderwertig/keine menschen"),
    "fr": masked("vermine sous-hommes parasites rats cafards racaille ordures animaux sauvages bêtes") + listed("un fléau/une peste/un cancer/inférieurs"),
    "es": masked("alimañas parásitos ratas cucarachas escoria basura animales salvajes infrahumanos bestias") + listed("una plaga/una peste/un cáncer/inferiores"),
}
CRIMES = {
    "en": masked("thieves thief criminals criminal rapists rapist murderers murderer terrorists terrorist liars liar parasite cheats"), "de": masked("diebe verbrecher vergewaltiger mörder terroristen lügner betrüger kriminelle"),
    "fr": masked("voleurs criminels violeurs meurtriers terroristes menteurs délinquants"), "es": masked("ladrones criminales violadores asesinos terroristas mentirosos delincuentes"),
}
THEY = {
    "en": listed("they are/they re/they are all/they re all/they are nothing but/those people are/these people are/all of them are/that lot are"), "de": listed("die sind/sie sind alle/die sind alle/das sind/das sind alles/die sind nur/alle von denen sind"),
    "fr": listed("ce sont des/ce sont tous des/ils sont tous des/ces gens sont des/ces gens là sont des/c est de la"), "es": listed("son todos/todos son/son todos unos/esa gente son/son unos/esa gente es"),
}
ARE = {"en": listed("are/are all/are nothing but/are just/are like"), "de": listed("sind/sind alle/sind nur/sind wie"), "fr": listed("sont de la/sont des/sont tous des/sont comme des"), "es": listed("son/son todos/son como/son unas/son unos")}
OUGHT = listed("should be/should all be/must be/must all be/have to be/need to be/ought to be/deserve to be/should have been")
FATE = listed("exterminated/wiped out/eliminated/eradicated/gassed/shot/hanged/deported/driven out/driven out of/kicked out/locked up/locked away/thrown out/sterilized/sterilised/burned alive/sent back/put down/killed/beaten/banned from our/purged/cleansed")
GROUPS = listed("jews/muslims/christians/hindus/blacks/whites/gays/lesbians/homosexuals/transgender people/immigrants/migrants/refugees/foreigners/gypsies/arabs/asians/africans/mexicans/women/disabled people/juden/muslime/ausländer/flüchtlinge/zigeuner/schwarze/homosexuelle/juifs/musulmans/arabes/noirs/immigrés/étrangers/tziganes/judíos/musulmanes/moros/negros/inmigrantes/extranjeros/gitanos/maricones")

HATE = {
    1.0: (
        *(phrase for lang in THEY for phrase in (*each(THEY[lang], DEHUMAN[lang]), *each(THEY[lang], CRIMES[lang]))),
        *each(listed("every one of them is a/every single one of them is a/each of them is a/every one of you people is a"), CRIMES["en"]),
        *each(listed("breed like/breeds like/multiply like/multiplies like/spread like"), listed("~rats/~cockroaches/~vermin/~lice/~animals")), *each(("vermehren sich wie", "vermehrt sich wie"), DEHUMAN["de"]),
        *each(listed("se reproduisent comme des/se multiplient comme des"), DEHUMAN["fr"]), *each(listed("se reproduce como/se reproducen como/se multiplican como"), DEHUMAN["es"]),
        *each(listed("kill all/i hate all/gas all/death to all/exterminate the/deport all"), GROUPS), *listed("go back to your country/go back where you came from/geht zurück in euer land/rentrez chez vous/volveos a vuestro país/deserves to breathe the same air/deserve to breathe the same air/no right to exist/white power/sieg heil/heil hitler"),
    ),
    0.6: (
        *(phrase for lang in ARE for phrase in each(ARE[lang], DEHUMAN[lang])), *each(OUGHT, FATE),
        *listed("do not belong among/do not belong here/don t belong here/does not belong among/have no place among/no place among decent/breathe the same air/never trust a/never trust an/never trust any/people with that faith/people of that faith/their kind/your kind/those people/no dogs/hang a sign/gas the/~subhuman/~vermin/driven out of/burn them all/keep our country/our country clean/be clean again/clean again/replace us/pollute our/race traitor"),
        *listed("gehören vertrieben/gehören aus/vertrieben/gehören vergast/gehören weggesperrt/gehören ausgerottet/gehören abgeschoben/solche leute/solches pack/traue nie einem/trau keinem/~ungeziefer/~untermenschen/ausländer raus/stinkt seit/stinken alle/keine menschen wie wir"),
        *listed("il faut les chasser/il faut les expulser/il faut les éliminer/il faut les exterminer/ces gens là/ces gens/ne fais jamais confiance à un/ne faites jamais confiance à un/pue depuis/puent depuis/~vermine/n ont rien à faire ici/dehors les"),
        *listed("hay que echarlos/hay que expulsarlos/hay que exterminarlos/hay que eliminarlos/hay que matarlos/esa gente/esa gentuza/nunca te fíes de un/no te fíes de un/apesta desde/apestan desde/~alimañas/no pintan nada aquí/fuera de nuestro país"),
    ),
    0.55: (*listed("burn the/quarter down/ghetto down/smoke them out/clean up the/decent people/decent folk/same air as us"),),
    0.4: (*GROUPS, "all of them", "~filth", "~rats", "~thief", *CRIMES["de"], *CRIMES["fr"], *CRIMES["es"]),
}

# ---------------------------------------------------------------- explicit sexual language

HIS = listed("his/her/my/your/their/the")
GENITALS = masked("cock dick pussy tits boobs ass clit cunt balls nipples penis vagina genitals")
ACTS = forms("fuck lick suck finger rid:ride spank strok:stroke penetrat:penetrate grop:grope pound", "s", "es", "ed", "e", "ing")
PORN = masked("porn porno pornos pornofilm pornfilm pornography pornographic pornographie pornografía hentai")

SEXUAL = {
    1.0: (
        *each(ACTS, HIS, GENITALS), *each(forms("suck jerk ", "s", "ed", "ing"), ("him", "me", "her", "himself", "herself"), ("off",)), *each(("hardcore", "hard", "harter", "harte", "harten", "xxx", "amateur", "uncut", "dirty"), PORN),
        *each(("video", "vídeo", "film", "clip", "película", "vidéo", "movie"), PORN), *each(PORN, ("video", "clip", "film", "movie", "pics", "tape", "actress", "scene")),
        *each(("came", "comes", "cum", "cums", "cumming"), ("in", "on", "inside", "all over"), ("her", "him", "me", "his", "her face", "her tits")), *listed("~sex tape/~blowjob/~blow job/~handjob/~cumshot/~gangbang/~deepthroat/~threesome video/send ~nudes/send me ~nudes/~dick pic/~dick pics/full frontal ~nude/legs spread wide/spread her legs/lick every inch/enters her slowly/rides him on camera/rides her on camera/naked and ~horny/wet ~pussy/hard ~cock/gets ~fucked/oral and anal/~masturbating on/~masturbates on camera"),
        *listed("film ~porno/~pornofilm/beine breit und/~fickt sie/~fickt ihn/bläst ihm einen/lutscht seinen ~schwanz/leckt ihre ~muschi/~schwanz in ihre/suce sa ~bite/la baise/lèche sa ~chatte/~sexe en gros plan/nu intégral/desnudo integral/se la folla/follando con/le chupa la ~polla/mamada"),
    ),
    0.6: (
        *PORN, *each(("his", "her", "of his", "of her"), GENITALS), *each(("finger", "fingers", "fingered", "fingering", "rides", "riding", "enters", "penetrates", "mounts", "fucks", "fucked"), ("her", "him")), *each(("her", "his"), ("~naked body", "~nude body")),
        *masked("horny genitalien genitales génitales nacktaufnahme nacktaufnahmen orgasm orgasmus orgasme orgasmo blowjob masturbate masturbating masturbation cum dildo bukkake milf slutty"), *listed("legs spread/legs wide open/oral anal/anal sex/oral sex/adults only/until he comes/until she comes/sexually explicit/she strips/he strips/strips naked/strip tease/takes off everything/take off everything/of an adult couple/xxx folder/xxx video/xxx videos/xxx movie/xxx clip/xxx clips/xxx pics/xxx content/xxx rated/~porn folder"),
        *listed("beine gespreizt/beine breit/dringt in sie ein/dringt langsam in sie ein/dringt tief in sie ein/nackt und ~geil/ziehen sich aus/mit einem erwachsenen paar/nur für erwachsene/jambes écartées/la pénètre/le pénètre/se déshabillent/couple adulte/réservé aux adultes/piernas abiertas/la penetra/le penetra/se desnudan/pareja adulta/solo para adultos"),
    ),
    0.4: (*masked("naked nude cock pussy penis vagina anal fuck nackt sexe desnudo desnuda nu nue titten schwanz bite chatte polla"), *listed("moans/moaning/groans with/close up/uncut/on camera/while the camera runs/die kamera läuft/en gros plan/en primer plano/ganz nah/devant la caméra/ante la cámara/stöhnt/gémit/gime/erotic/erotisch/érotique/erótico/lingerie/hardcore")),
}

#: category -> weight -> phrases.
LEXICON: dict[str, dict[float, tuple[str, ...]]] = {"abuse": ABUSE, "hate": HATE, "sexual": SEXUAL}

#: Phrases in which those words are innocent.
EXCEPTIONS: tuple[str, ...] = (
    *each(INSULTS["en"], ("like you",), listed("would not/wouldn t/would n t/want/said/see/expect")),
    *each(listed("was called a/was called an/called me a/called me an/called him a/called her a/i am a/i am an/i was a/i was an/i am such a/i am such an/i felt like a/feel like a/feel like an/felt like a/felt like an/me looks like a"), INSULTS["en"]),
    *each(listed("bastard/stupid/dumb/useless/idiot"), listed("file/files/disk/drive/script/cable/printer/mistake/question/idea/box/folder/waiter/proof/screen/menu/update/lens/battery/driver/program")),
    *each(I_WILL, ("kill", "beat", "crush", "destroy", "murder", "smash"), ("you",), listed("at/in chess/in the game/in the race/in the next/on the tennis")),
    *each(("kill", "shoot", "burn", "hang", "drown"), ("the",), listed("process/stuck/job/lights/picture/pictures/portrait/video/scene/disc/disk/dvd/cd/image/onions/photo/painting/plants/wood/candles/garlic/toast/film/iso")),
    *each(listed("cockroaches/rats/mice/lice/pests/weeds/ticks/fleas/moths/aphids/slugs"), ARE["en"], DEHUMAN["en"]), *each(("ticks", "fleas", "lice", "mistletoe", "leeches", "worms"), ARE["en"], ("~parasites",)),
    *listed("naked eye/nude study/nude lipstick/nude tones/museum label/oil sketch/life drawing/marble nude/cock a leekie/rooster cock/chicken breast/cock pheasant/male and female plug/male and female connector/screw nut/tit mouse/blue tit/great tit/rats bred in the/lab rats/die cutting/die cast/pussy willow/pussy cat/moby dick/dick van dyke/close up lens/close up of the flower/close up filter/an ass and a/wild ass/penal code/analysis of/analog/breeds like/adults only swim/adults only ticket/no dogs on/no dogs allowed/no dogs in"),
    *listed("aktstudie/nackte wand/nackter fels/nackte tatsachen/nu en marbre/nu artistique/étude de nu/à l œil nu/pieds nus/mise à nu/estudio de desnudo/desnudo en mármol/pies desnudos/a simple vista/a ojo desnudo/dance group from/haben wunderbar getanzt/ces gens charmants/esa gente maravillosa/solche leute braucht"),
)
#: Letters that look like others, and digits and signs written for letters.
FOLDS: dict[str, str] = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ѡ": "w", "ɡ": "g", "ӏ": "l", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "€": "e", "*": "*",
}
