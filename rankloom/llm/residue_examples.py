"""Grammars the residue models are fitted on. What systems and authors leave in place of content.

Written from the status phrases of HTTP, the wording browsers and frameworks use, and editors' usual placeholders, not
from any corpus. In a template, {a|b} is one of the alternatives (one may be empty) and a name in angle brackets is one
of a list.
"""

from __future__ import annotations

import itertools
import re

STATUS = "400 Bad Request|401 Unauthorized|403 Forbidden|404 Not Found|405 Method Not Allowed|408 Request Timeout|410 Gone|429 Too Many Requests|500 Internal Server Error|502 Bad Gateway|503 Service Unavailable|503 Service Temporarily Unavailable|504 Gateway Timeout|504 Gateway Time-out"
LISTS = {
    "thing": "page|document|resource|file|posting|job|position|profile|article|content|site",
    "status": STATUS,
    "script": "JavaScript|Javascript|scripts|scripting|JavaScript and cookies|cookies and scripts",
    "hex": "7f3a91c2|0c4e8d|a1b2c3d4|93fe07|5d20ab61",
    "text": "text|content|description|summary|headline|paragraph|title|copy",
    "chose": "page|ressource|annonce|offre|adresse",
    "ding": "Seite|Ressource|Stelle|Anzeige|Datei",
    "cosa": "página|oferta|vacante|dirección",
}

NOTICES = """
<status>
{Error|HTTP|HTTP Error|Status} <status>{.|}
<status>. The {requested <thing>|requested URL|<thing> you requested} was not found on this server.
<html><head><title><status></title></head><body><center><h1><status></h1></center><hr><center>server</center></body></html>
<h1>{<status>|Access Denied|Page not found|Server Error|Something went wrong}</h1>
{Page|Document|File|Resource|Job|Profile} not found{. Go back to the home page|. Check the address and try again|}.
The <thing> you {requested|are looking for|were looking for|tried to open} {could not be found|was not found|cannot be found|does not exist|has been removed|is no longer available|may have been moved}.
This <thing> {is no longer available|does not exist|does not exist or has been moved|has expired|has been removed|has been filled|cannot be displayed|is not available|could not be loaded|is no longer accepting applications}.
{Sorry, |Oops! |We're sorry, |We are sorry, |}{we can't find the <thing> you're looking for|we could not find that <thing>|something went wrong|an error occurred|that <thing> doesn't exist|there was a problem loading this <thing>}.
{Please |}{try again later|try again in a few minutes|check the address and try again|contact the administrator|contact the site owner|go back to the home page|return to the previous page|return to the search page|reload the page|refresh the page and try again}.
{Access|Permission} {denied|forbidden}. {You do not have permission to view this <thing>.|Access to this <thing> is forbidden.|Reference <hex>|Please sign in.}
You {do not have permission|don't have permission|are not authorized|are not allowed|must sign in|need to log in} to {access|view|open|see} this <thing>.
Your session has {expired|timed out|ended}. Please {log in|sign in|log in again|sign in again}{ to continue|}.
Please {log in|sign in} to {continue|view this <thing>}.
The server {encountered an internal error|encountered an error|is temporarily unable to service your request|is busy|did not respond in time|is down for maintenance}{ and could not complete your request| and was unable to complete your request|}.
{The|This} service is {temporarily|currently} unavailable{. Please try again later|}. We are down for {maintenance|scheduled maintenance}.
{Internal|Unexpected} error while {loading|rendering|processing} {the page|template|the template|your request|profile}{: value is None|}
An {unexpected|internal|unknown} error {occurred|has occurred}{ while processing your request|}. Something went wrong on our {end|side}.
{Too many requests|Rate limit exceeded|Request blocked}. {Please slow down|Retry after 30 seconds|Retry later|Incident <hex>|Request id <hex>}. If you think this is {an error|a mistake}, contact {us|the site owner}.
{Incident|Reference|Request|Error|Trace} {id|code|number|ID}{:|} <hex>
The connection {has timed out|timed out|was reset|was refused}. Check your {network|internet|connection} and {reload|try again}. Unable to connect to the {server|database}.
Traceback (most recent call last): File "/app/main.py", line 40, in handler {KeyError|TypeError|ValueError|NullPointerException}
{Fatal error|Warning|Notice}: {Uncaught exception|Uncaught TypeError|undefined variable|undefined index} {in /var/www/view/page.php|in /app/main.js|} on line 12
{undefined|null|NaN|[object Object]} {undefined|null|NaN|[object Object]} {undefined|null|at|years} {undefined|null|NaN|[object Object]}
{JavaScript|Javascript|Scripting} is {disabled|turned off|blocked|not enabled|switched off} in your browser{; the <thing> cannot be displayed|. Some parts of the <thing> will not load|, so no content is shown|}.
Scripts are {disabled|turned off|blocked|switched off}. {Some parts of the <thing> will not load|No content is shown|The <thing> cannot be displayed}.
{Please |You need to |You must |}{enable|activate|turn on|allow|switch on} <script> {to view this <thing>|to continue|to use this site|to run this app|in your browser|in your browser settings|and reload|and refresh the page|to see the content|to apply}.
To {apply|continue|view this <thing>|see this <thing>}, {enable|activate|allow|turn on} <script>{, then refresh| and reload|}.
This {site|page|app|application|website} {requires|needs|works only with} {JavaScript|scripts|JavaScript to be enabled|scripts to be allowed}. {Turn it on|Turn them on|Enable it|Allow them} in your browser{ and reload|}.
Your browser {does not support|blocks|does not run|has disabled} <script>{, so no content is shown|, so nothing is shown|}.
We're sorry but this {app|site} doesn't work properly without JavaScript enabled. Please enable it to continue.
<noscript>{You need to enable JavaScript to run this app.|JavaScript is required.|Please turn on scripts.|Scripts are switched off.}</noscript>
Checking your browser before {access|accessing this site|you continue}. This {takes|may take} up to {5|10} seconds. {Cookies|Scripts|Cookies and scripts} must be {allowed|enabled}.
{Please verify|Verify|Confirm} {you are a human|you are human|that you are not a robot}.
Erreur {404|403|500|503} : {page introuvable|page non trouvée|accès refusé|erreur interne du serveur|service indisponible}.
La <chose> {demandée|que vous cherchez|que vous avez demandée} {est introuvable|n'existe pas|n'existe plus|n'a pas été trouvée|a été déplacée}.
Cette <chose> {n'est plus disponible|n'existe plus|a expiré|est introuvable|a été pourvue|ne peut pas être affichée}.
Accès {refusé|interdit}. {Référence <hex>|Vous n'avez pas l'autorisation de consulter cette page.|Vous n'êtes pas autorisé à accéder à cette page.}
Le service est {momentanément|temporairement|actuellement} indisponible. {Veuillez réessayer plus tard.|Maintenance en cours.|Merci de réessayer ultérieurement.}
Votre session a expiré. Veuillez vous {reconnecter|connecter de nouveau|identifier}. {Trop de requêtes.|La connexion a expiré.|Le délai est dépassé.}
Une erreur {est survenue|s'est produite|inattendue est survenue}{, veuillez réessayer plus tard|. Réessayez plus tard|}.
{Veuillez|Merci de|Vous devez} {activer|autoriser} {JavaScript|les scripts|JavaScript et les cookies} {pour afficher cette page|pour continuer|dans votre navigateur|puis recharger la page|pour voir le contenu|pour postuler}.
JavaScript est {désactivé|bloqué} dans votre navigateur. {Ce site|Cette page|Cette application} {nécessite|requiert|exige} {JavaScript|l'exécution de scripts|l'activation de JavaScript}{ ; autorisez-les puis rechargez|}.
Fehler {404|403|500|503}: {Seite nicht gefunden|Zugriff verweigert|interner Serverfehler|Dienst nicht verfügbar}.
Die {angeforderte|gesuchte|gewünschte} <ding> {wurde nicht gefunden|existiert nicht|ist nicht mehr verfügbar|konnte nicht gefunden werden}.
Diese <ding> {ist nicht mehr verfügbar|existiert nicht mehr|ist abgelaufen|wurde entfernt|kann nicht angezeigt werden}.
Zugriff verweigert. {Vorgang <hex>|Referenz <hex>|Sie haben keine Berechtigung, diese Seite zu sehen.}
Der {Dienst|Server} ist {vorübergehend|momentan|derzeit} nicht {erreichbar|verfügbar}. {Bitte versuchen Sie es später erneut.|Wartungsarbeiten.}
{Die|Ihre} Sitzung ist abgelaufen. Bitte melden Sie sich {erneut|wieder} an. {Zu viele Anfragen.|Zeitüberschreitung der Verbindung.}
Ein {Fehler|unerwarteter Fehler} ist aufgetreten{, bitte versuchen Sie es später erneut|. Bitte später erneut versuchen|}.
Bitte {aktivieren|erlauben} Sie {JavaScript|Skripte|JavaScript und Cookies}{, um diese Seite zu sehen|, um fortzufahren|, um den Inhalt anzuzeigen|, um sich zu bewerben| und laden Sie die Seite neu}.
JavaScript ist in Ihrem Browser {deaktiviert|ausgeschaltet|blockiert}. {Für diese Anwendung|Für diese Seite} {müssen Skripte im Browser erlaubt sein|muss JavaScript aktiviert sein|wird JavaScript benötigt}.
Error {404|403|500|503}: {página no encontrada|acceso denegado|error interno del servidor|servicio no disponible}.
La <cosa> {solicitada|que busca|que ha solicitado} {no existe|no se ha encontrado|no se encuentra|ya no está disponible}.
Esta <cosa> {ya no está disponible|ya no existe|ha caducado|no existe|no se puede mostrar}.
Acceso denegado. {Referencia <hex>|No tiene permiso para ver esta página.|No está autorizado.}
El {servicio|servidor} no está disponible {en este momento|temporalmente}. {Vuelva a intentarlo más tarde.|Estamos en mantenimiento.}
Su sesión ha {caducado|expirado}. {Inicie sesión de nuevo|Vuelva a iniciar sesión}. {Demasiadas solicitudes.|Se agotó el tiempo de conexión.}
Se ha producido un error{, inténtelo más tarde| inesperado|. Inténtelo de nuevo más tarde|}.
{Active|Habilite|Debe activar|Por favor, active} {JavaScript|los scripts|JavaScript y las cookies} {para ver esta página|para continuar|en su navegador|y recargue la página|para ver el contenido|para postularse}.
JavaScript está {desactivado|deshabilitado|bloqueado} en su navegador. {Este sitio|Esta página|Esta aplicación} {necesita|requiere} {JavaScript|que el navegador permita scripts|que active JavaScript}.
""".strip().splitlines()

FILLER = """
{Insert|Add|Enter|Write|Type|Put} {your|a short|the|some|a brief} <text> {here|of the position here|of the position|of yourself here|about yourself here}.
Write something about {yourself|the role|the team|this position} here. {Tell us about yourself here.|Say something about your work here.}
{Your|The|Some|More} <text> {here|goes here|will go here|to follow|coming soon|comes here}.
{Sample|Dummy|Placeholder|Filler|Example|Demo|Blind} <text>{ for the layout| for layout only|, replace before publishing|, to be replaced|, remove before release|}. {Sample|Dummy|Placeholder|Filler} <text> {sample|dummy|placeholder|filler} <text>.
Describe {your|the} {role|main duties|main tasks|experience|position} {in two or three sentences|in a few words|here|briefly here}.
{This is|Here is} {sample|dummy|placeholder} <text>{ for the layout| to be replaced| only|}. {Click here to edit|Click to add} {text|title|a description}.
{TODO|FIXME|TBD|TBA}: {fill in later|to be completed|add <text>|write this section|complete this}. {Content coming soon.|To be completed.|Description to follow.|TBD TBD TBD}
test test test {1|test|2} test test {test|3|abc} test
xxxx xxxxx xx xxxxxx xxx xxxx xxxxx xx xxxxxx xxx xxxxxxx
asdf asdf {qwer|jkl|asdfgh} qwerty asdf jkl asdf qwer {zxcv|asdf} asdfasdf
bla bla bla blah blah blah foo bar baz foo bar
{Texte|Contenu|Paragraphe|Titre} {de remplissage|provisoire|à remplacer|à venir|à compléter|ici}{ avant publication|}. Le texte viendra ici. Votre texte ici. {Ajoutez|Saisissez|Insérez} {votre texte|une brève description du poste|une description} ici. Décrivez ici {le poste|vos missions|votre parcours} en quelques {mots|phrases}.
{Blindtext|Platzhaltertext|Fülltext|Beispieltext|Mustertext} {Blindtext|Platzhalter|hier|folgt}. {Hier steht später der Text.|Hier Text einfügen.|Bitte Text ergänzen.|Ihr Text hier.|Text folgt.} {Platzhalter|Absatz}, vor der Veröffentlichung {ersetzen|zu ersetzen}. {Beschreiben Sie hier Ihre Aufgaben.|Geben Sie eine kurze Beschreibung ein.|Schreiben Sie hier etwas über sich.}
Texto de {relleno|ejemplo|prueba|muestra}{, sustituir antes de publicar|, a sustituir|}. {Aquí va el texto.|Inserte el texto aquí.|Su texto aquí.|Texto pendiente.} {Escriba una breve descripción.|Describa aquí sus funciones.|Escriba aquí algo sobre usted.} Párrafo {provisional|de ejemplo}.
""".strip().splitlines()

#: The usual filler words, as typesetters use them.
LOREM = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit
voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt
mollit anim id est laborum vestibulum curabitur aliquam nullam sapien vivamus pulvinar fermentum mattis ornare porta lectus
rutrum sodales nibh eget mauris pellentesque tincidunt vitae integer donec praesent phasellus suspendisse maecenas vulputate""".split()

#: What encloses a slot.
STYLES = [("{{", "}}"), ("{{ ", " }}"), ("${", "}"), ("#{", "}"), ("<%= ", " %>"), ("{% ", " %}"), ("%%", "%%"), ("[[", "]]"), ("<<", ">>"), ("*|", "|*"), ("__", "__"), ("@", "@"), ("{", "}"), ("%(", ")s"), ("&lt;", "&gt;"), ("[", "]"), ("[ ", " ]"), ("<", ">"), ("{{{", "}}}"), ("<?= ", " ?>"), ("$", "$")]
#: What stands in a slot as an identifier.
NAMES = "name first_name last_name full_name candidate candidate_name your_name recruiter hiring_manager manager company company_name employer team department job_title title position role location city country start_date end_date date years notice_period salary salary_range skill skill_1 skill_2 email phone".split()
#: What stands in a slot as a request to the author.
REQUESTS = """your name|company name|insert company name|job title|insert job title|insert location here|location|date|start date|number of years|years|add salary range|salary|candidate name|candidate first name|hiring manager|recruiter|team name|city|skill|add description|insert date|to be completed|tbd
votre nom|nom de l'entreprise|intitulé du poste|ville à compléter|date de début|nombre d'années|salaire à compléter|prénom du candidat|à compléter
ihr name|name einfügen|firmenname einfügen|stellenbezeichnung|ort eintragen|startdatum|anzahl der jahre|gehalt ergänzen|name des bewerbers
su nombre|nombre de la empresa|título del puesto|ciudad|fecha de inicio|fecha|número de años|añadir salario|nombre del candidato""".replace("\n", "|").split("|")
_TAGS = re.compile(r"<(" + "|".join(LISTS) + r")>")


def expand(template: str, most: int = 24) -> list[str]:
    """The texts of a template; if there are more than ``most``, as many at even distances."""
    previous = None
    while previous != template:
        previous, template = template, _TAGS.sub(lambda m: "{" + LISTS[m.group(1)] + "}", template)
    parts: list[list[str]] = []
    depth, word, options = 0, "", []
    for c in template:
        if c == "{" and depth == 0:
            parts.append([word])
            word, options, depth = "", [], 1
        elif c == "{":
            depth, word = depth + 1, word + c
        elif c == "}" and depth == 1:
            parts.append([*options, word])
            word, depth = "", 0
        elif c == "}":
            depth, word = depth - 1, word + c
        elif c == "|" and depth == 1:
            options, word = [*options, word], ""
        else:
            word += c
    parts.append([word])
    parts = [[y for x in p for y in (expand(x, 12) if "{" in x else [x])] for p in parts]
    total = 1
    for p in parts:
        total *= len(p)
    out = []
    n = min(total, most)
    for k in range(n):
        at, text = k * total // n + (k * 7919) % max(1, total // n), []
        for p in reversed(parts):
            text.append(p[at % len(p)])
            at //= len(p)
        out.append("".join(reversed(text)))
    return out


def slots() -> list[str]:
    """Slots between neutral neighbours."""
    out = []
    ends = ["{} ", "{}, ", "{}. ", "{}; ", "{}\n", "({}) "]
    k = 0
    for (a, b), n in itertools.product(STYLES, NAMES):
        for form in sorted({n, n.replace("_", " ") if "_" in n and a.strip() in ("[", "<", "&lt;", "{{", "[[") else n, n.replace("_", "")}):
            out.append(" " + ends[k % len(ends)].format(a + form + b))
            k += 1
    for a, b in (s for s in STYLES if s[0].strip() in ("[", "<", "&lt;", "[[", "<<", "{{")):
        for r in REQUESTS:
            out.append(" " + ends[k % len(ends)].format(a + r + b))
            k += 1
    return out


def lorem(words: int = 4000) -> str:
    """Filler words in a fixed shuffled order."""
    out, x = ["lorem ipsum dolor sit amet"], 1
    for k in range(words):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(LOREM[(x >> 8) % len(LOREM)] + ("." if k % 13 == 12 else ""))
        if k % 60 == 59:
            out.append("\nlorem ipsum dolor sit amet")
    return " ".join(out)


def examples() -> dict[str, list[str]]:
    return {"notice": [x for t in NOTICES for x in expand(t)], "filler": [*(x for t in FILLER for x in expand(t)), lorem()], "slot": slots()}
