"""The vocabulary of the URL filter: base terms by language and weight, and the rule that makes their forms."""

from __future__ import annotations

#: Weights of terms, and the sum from which a URL is rejected: one strict term, two soft ones, or one soft and three weak
#: ones. Strict are terms that no clean page has in its address; what news, advice and shops have as well is soft or weak.
STRICT, SOFT, WEAK, LIMIT = 6, 3, 1, 6
#: Forms that are words or places of their own.
APART = frozenset({"paris", "rates", "nuts"})

# Base terms, without accents and in ASCII as hosts and paths have them.
TERMS = {
    STRICT: {
        "en": "casino porn porno xxx pill viagra cialis escort spam warez camgirl hentai milf upskirt gangbang creampie blowjob handjob hardcoresex sexcam sexchat torrentz crackz keygen serialz nulled carding fullz levitra xanax oxycontin baccarat blackjack sportsbook sportsbet payday sugardaddy fetish bdsm",
        "de": "spielbank gluecksspiel spielautomat sportwette pornos nutte hure bordell sexkontakt fickfilm sexfilm raubkopie potenzmittel schneeballsystem erotikfilm telefonsex sexinserat",
        "fr": "pornographie prostituee putes salope sexefilm escorte rencontrecoquine plancul machinesasous parissportif pilulebleue camsexe sexetel",
        "es": "pornografia prostituta putas zorras sexogratis tragamonedas tragaperras apuestadeportiva pastillaazul camsexo chicacam sexotel videoxxx cacheras",
    },
    SOFT: {
        "en": "cheap free bet betting win ad track farm poker jackpot bonus slot dating loan adult click promo discount coupon deal prize lottery bingo gambling wager credit debt mortgage refinance insurance replica pharmacy pharma drug diet slimming weightloss horny hookup singles nude naked sexy babe erotic crack hack cheat proxy doubler giveaway sweepstake affiliate popunder clickbait backlink forex binary earn richquick miracle enlargement steroid roulette scam tramadol valium",
        "de": "billig gratis umsonst wette gewinn gewinnspiel lotterie kredit darlehen rabatt gutschein schnaeppchen erotik nackt heiss flirt singleboerse seitensprung abnehmen diaet apotheke rezeptfrei nebenverdienst schnellreich werbung partnerlink geldverdienen freispiel abzocke kettenbrief",
        "fr": "gratuit cadeau gagner loterie pari paris credit pret rabais promotion solde rencontre coquin coquine nue erotique regime minceur pharmacie sansordonnance argentfacile publicite tirage jeuxdargent arnaque hameconnage",
        "es": "barato regalo ganar loteria apuesta credito prestamo descuento oferta cupon citas soltera desnuda erotico dieta adelgazar farmacia sinreceta dinerofacil publicidad sorteo premio juegosdeazar estafa",
    },
    WEAK: {
        "en": "hot best buy sale offer shop order now today instant easy fast secret exclusive vip limited guaranteed cash money income bitcoin crypto download stream watch unlock unlimited trial signup subscribe popup banner tracker redirect phishing malware ransomware keylogger trojan botnet",
        "de": "kaufen angebot bestellen jetzt sofort geheim exklusiv garantiert geld einkommen herunterladen ansehen anmelden kostenlos",
        "fr": "acheter offre commander maintenant immediat secret garanti revenu telecharger regarder abonnement bonplan",
        "es": "comprar pedido ahora inmediato secreto garantizado dinero ingreso descargar mirar suscripcion chollo",
    },
}
#: Endings that forms of a term may have, by language.
ENDINGS = {"en": ("", "s", "es", "z"), "de": ("", "s", "e", "n", "en", "er"), "fr": ("", "s", "es", "x"), "es": ("", "s", "es")}
#: Digits that stand for letters.
DIGITS = str.maketrans("aeios", "43105")


def forms(term: str, language: str) -> list[str]:
    """A term with its endings; terms of five letters and more also with digits for letters: all of them, or only vowels."""
    out = [term + e for e in ENDINGS[language]]
    if len(term) >= 5:
        out += [t for f in out[:2] for t in (f.translate(DIGITS), f.translate({k: v for k, v in DIGITS.items() if chr(k) != "s"})) if not t.isdigit()]
    return out


def vocabulary() -> dict[str, tuple[str, int]]:
    """Every form with its base term and weight. Where terms share a form, that of the greater weight has it, then the earlier."""
    out: dict[str, tuple[str, int]] = {}
    for weight in sorted(TERMS, reverse=True):
        for language, terms in TERMS[weight].items():
            for term in terms.split():
                for f in forms(term, language):
                    if f not in APART:
                        out.setdefault(f, (term, weight))
    return out
