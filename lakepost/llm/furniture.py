"""Lines of mails that are no running text: quotation marks, headers, closings, device lines and notices by their words."""

from __future__ import annotations

import re

import ahocorasick
import regex

_QUOTE = regex.compile(r"^[ \t]*(?:\p{L}{0,3}[>|»][ \t]?)+")
_MARKED = regex.compile(r"^[ \t]*(?:[\p{Lu}\p{Lo}]{0,3}>|[|»>])")
# Verbs of lines that introduce a quotation.
_WROTE = regex.compile(r"(?i)\b(wrote|writes|pisze|napisa\S*|schrieb|schreibt|a ?écrit|ecrit|escribió|escribi\S*|escreveu|ha scritto|scrive|napsal\S*|píše|schreef|schrijft|skrev|skriver|пишет|написал\S*|писал\S*|пише|написав\S*|писав\S*)\b|\p{L}*crit\b ?:|のメール|書きました|wrote:|さんは|:$")
_DATE = regex.compile(r"\d{4}|\d{1,2}[./]\d{1,2}|\d{1,2}:\d{2}")
_SEPARATOR = regex.compile(r"^[ \t>|*_]*[-–—_=]{3,}[ \t]*\S.*?[-–—_=]{3,}[ \t*]*$|^[ \t]*(?:Begin forwarded message|Początek przekazanej|Anfang der weitergeleiteten|Début du message|Inizio messaggio)")
# Names of header lines in forwarded mails.
_HEADS = "From|Sent|To|Cc|Subject|Date|Od|Wysłano|Data|Do|DW|UDW|Temat|Von|Gesendet|An|Betreff|Datum|De|Envoyé|À|A|Objet|Date|Enviado|Enviada|Para|Asunto|Assunto|CC|Da|Inviato|Oggetto|Odesláno|Komu|Kopie|Předmět|Van|Verzonden|Aan|Onderwerp|Från|Skickat|Till|Ämne|От|Отправлено|Кому|Тема|Дата|Копия|Від|Надіслано|Копія|差出人|送信日時|宛先|件名|日時|送信者"
_HEAD = regex.compile(rf"^[ \t*_]*(?:{_HEADS}|\p{{L}}[\p{{L}}\p{{P}}\p{{S}}\x80-\xff]{{1,14}})[ \t]?[*_]*[:：][*_]*[ \t]*\S")
_FROM = regex.compile(r"^[ \t*_]*(?:From|Od|Von|De|Da|Van|Från|От|Від|差出人|送信者|Expéditeur|Remetente|Mittente)[ \t]?[*_]*[:：][*_]*[ \t]*\S")
# Closing formulas, by their first words.
_CLOSING = regex.compile(
    r"(?i)^[ \t]*(?:(?:z |łączę |serdeczn|pozdraw|z poważaniem|z wyrazami|z uszanowaniem|dziękuję i pozdrawiam|miłego dnia|best|kind|warm|many thanks$|many thanks,|thanks,?$|thank you,?$|regards|yours|sincerely|cheers|cordially|mit (?:freundlich|best|herzlich|lieb)|freundliche|viele gr|beste gr|schöne gr|liebe gr|herzliche gr|hochachtungs|mfg|cordialement|bien (?:à|cordialement)|sincères|salutations|meilleures|bonne (?:journée|réception)|amicalement|respectueusement|veuillez agréer"
    r"|atentamente|saludos|un (?:cordial )?saludo|un abrazo|cordialmente|muy atentamente|reciba|atenciosamente|com os melhores|melhores cumprimentos|cumprimentos|um abraço|obrigad[oa],?$|cordiali|distinti|un saluto|cari saluti|saluti|a presto|s (?:pozdravem|úctou|přáním)|hezký (?:den|zbytek)|děkuji,?$|zdraví|met (?:vriendelijke|hartelijke|beste)|vriendelijke|hartelijke gr|groet|hoogachtend|vänlig|med vänlig|hälsning|bästa hälsning|mvh|hej då|tack,?$"
    r"|с уважением|искренне|с наилучшими|всего (?:доброго|хорошего)|спасибо,?$|до свидания|з повагою|щиро|з найкращими|гарного дня|дякую,?$|всього найкращого|以上|よろしくお願い|敬具|草々|何卒)[^.?!。]{0,40}[,.!。]{0,2}[ \t]*$)"
)
# Lines that a device adds.
_DEVICE = regex.compile(
    r"(?i)^[ \t]*(?:sent from|sent with|get outlook|wysłan[oae] (?:z|przez|za)|wysłane|von meine|gesendet (?:von|mit)|envoyé (?:de|depuis|à partir)|enviado (?:desde|do|a partir|de|pelo|com)|enviada|inviato (?:da|dal|con)|odesláno (?:z|ze)|posláno|verzonden (?:vanaf|met|van)|verstuurd|skickat från|skickat|отправлено (?:с|из)|отправлено|надіслано (?:з|із)|надіслано|iphoneから|携帯電話から|スマートフォンから|私の|.*から送信)[^.?!:]{0,60}\.?[ \t]*$"
)
# Words of legal, automatic and external-mail notices.
_NOTICE = regex.compile(
    r"(?i)\[?external\]?\b|\[extern|outside (?:the|your) organi[sz]ation|confidential|intended (?:only|solely|recipient)|received (?:it|this).{0,30}in error|delete it|notify the sender|think before you print|consider the environment|automated message|unattended mailbox|do not reply|automatic(?:ally)? (?:message|generated)|this (?:e-?mail|message) (?:may|is|was|and|has)"
    r"|poufn|wyłącznie dla adresat|omyłkowo|omyłkow|spoza organizacji|nie otwieraj|czy wydruk|wydruk.{0,20}konieczn|wiadomość automatyczn|automatyczn\S+ wiadomo|nie odpowiada\S* na|prosimy o rozważenie|usunięcie i powiadom|(?:ta|niniejsza) wiadomość"
    r"|vertraulich|ausschließlich für|irrtümlich|automatisch (?:erstellt|generiert|erzeugt)|diese (?:e-?mail|nachricht)|externe (?:e-?mail|nachricht)|vor dem (?:aus)?druck|nicht auf diese|absender außerhalb"
    r"|confidentiel|par erreur|destinataire|ce (?:message|courriel)|message automatique|ne pas répondre|avant d.imprimer|extérieur de l|este (?:mensaje|correo|e-mail|mensagem)|esta mensagem|confidencial|por error|por engano|únicamente|unicamente|destinatari|mensaje automático|mensagem automática|no responda|não responda|antes de imprimir|externo a la|fora da organização"
    r"|riservat|questo messaggio|per errore|messaggio automatico|non rispondere|prima di stampare|esterno all|důvěrn|tato zpráva|tento e-mail|omylem|automatick|neodpovídejte|před vytištěním|mimo organizaci|vertrouwelijk|dit bericht|deze e-?mail|uitsluitend bestemd|per vergissing|automatisch bericht|niet beantwoorden|buiten de organisatie"
    r"|konfidentiell|detta (?:meddelande|mejl|e-)|av misstag|automatiskt|svara inte|utanför organisationen|innan du skriver ut|конфиденциальн|это (?:письмо|сообщение)|по ошибке|автоматическ|не отвечайте|извне организации|перед печатью|конфіденційн|(?:цей лист|це повідомлення)|помилково|помилков|автоматичн|не відповідайте|ззовні організації|за межами"
    r"|機密|本メール|このメール|誤って|自動送信|自動配信|返信しない|社外|組織外|印刷する前"
)
_RULE = re.compile(r"^[ \t]*(?:[-_=*~#–—+.·•]{2,}|-- ?)[ \t]*$")


# Pieces of words one of which every notice holds.
_NOTICE_PIECES = (
    "extern|outside|confidential|intended|received|delete|notify|think before|consider|automat|unattended|reply|this mess|this mail|this e-|this email|poufn|adresat|omyłk|spoza|nie otwieraj|wydruk|nie odpowiada|prosimy o|usunięcie|wiadomość|vertraulich|ausschlie|irrtüm|diese |druck|nicht auf|absender"
    "|confidentiel|erreur|destinatai|ce message|ce courriel|répondre|imprimer|extérieur|este |esta |confidencial|error|engano|nicamente|destinatari|respond|imprimir|fora da|riservat|questo|errore|stampare|esterno|důvěrn|tato |tento |omylem|neodpov|vytiš|mimo |vertrouwelijk|dit bericht|deze |uitsluitend|vergissing|beantwoorden|buiten "
    "|konfiden|detta |misstag|svara|utanför|skriver ut|конфиденц|это |ошибке|автомат|не отвечайте|извне|печатью|конфіденц|цей лист|це повідомлення|помилков|не відповідайте|ззовні|за межами|機密|本メール|このメール|誤って|自動|返信|社外|組織外|印刷"
).split("|")


def _pieces():
    a = ahocorasick.Automaton()
    for x in _NOTICE_PIECES:
        a.add_word(x, True)
    a.make_automaton()
    return a


_PIECES = _pieces()


def _notice(line: str) -> bool:
    """Whether a line speaks like a notice; the automaton spares most lines the patterns."""
    return next(_PIECES.iter(line.lower()), None) is not None and _NOTICE.search(line) is not None


def strip_quote(line: str) -> str:
    return _QUOTE.sub("", line) if _MARKED.match(line) else line
