"""Prose of any language, told from other structures by its rhythm.

Function words need a list per language. What all written prose shares is its rhythm: how long its words are, what
follows them (a blank, a comma, the end of a sentence, a bare line break), and that a few short words keep coming
back. A block's three distributions are compared by Jensen-Shannon divergence with profiles of running prose in languages of
many families and with profiles of other structures; the nearest one decides. Scripts that don't part words are
measured between their punctuation marks.

Only blocks of letters are judged here; damaged encodings, where letters of two scripts meet inside a word, are none.
"""

from __future__ import annotations

import re

import numpy as np

#: Running prose by language, from which the profiles are computed.
PROSE = {
    "it": "Abbiamo trovato la causa del problema solo la sera, perché nessuno aveva pensato a una cosa così piccola. Il rapporto non viene più creato ogni notte, ma soltanto quando cambiano i dati. Se qualcuno non è d'accordo, lo può dire alla prossima riunione. La lista è troppo lunga e bisogna accorciarla prima di mandarla a tutti.",
    "pt": "Encontramos a causa do problema só à noite, porque ninguém tinha pensado em uma coisa tão pequena. O relatório já não é feito todas as noites, mas apenas quando os dados mudam. Se alguém não estiver de acordo, pode dizer isso na próxima reunião. A lista é longa demais e é preciso cortá-la antes de a enviar.",
    "nl": "We hebben de oorzaak van de fout pas in de avond gevonden, omdat niemand aan zo iets kleins had gedacht. Het verslag wordt niet meer elke nacht gemaakt, maar alleen als de gegevens veranderen. Wie het daar niet mee eens is, kan dat in het volgende overleg zeggen. De lijst is te lang en moet voor het afdrukken korter worden.",
    "sv": "Vi hittade orsaken till felet först på kvällen, eftersom ingen hade tänkt på något så litet. Rapporten skapas inte längre varje natt, utan bara när det kommer nya uppgifter. Den som inte håller med kan säga det på nästa möte. Listan är för lång och måste kortas innan vi skickar den till de andra.",
    "pl": "Przyczynę błędu znaleźliśmy dopiero wieczorem, bo nikt nie pomyślał o czymś tak małym. Raport nie jest już tworzony co noc, ale tylko wtedy, gdy zmieniają się dane. Kto się z tym nie zgadza, może to powiedzieć na następnym spotkaniu. Lista jest za długa i trzeba ją skrócić, zanim ją wyślemy do innych.",
    "cs": "Příčinu chyby jsme našli až večer, protože nikdo nemyslel na něco tak malého. Zpráva se už nevytváří každou noc, ale jen tehdy, když se změní data. Kdo s tím nesouhlasí, může to říct na příští schůzce. Seznam je moc dlouhý a musí se před odesláním zkrátit, jinak ho nikdo nebude číst.",
    "fi": "Löysimme vian syyn vasta illalla, koska kukaan ei ollut ajatellut niin pientä asiaa. Raporttia ei enää tehdä joka yö, vaan ainoastaan silloin kun tiedot muuttuvat. Jos joku on eri mieltä, hän voi sanoa sen seuraavassa kokouksessa. Lista on liian pitkä, ja sitä on lyhennettävä ennen kuin se lähetetään muille.",
    "hu": "A hiba okát csak este találtuk meg, mert senki sem gondolt egy ilyen apró dologra. A jelentés már nem készül el minden éjjel, hanem csak akkor, ha az adatok megváltoznak. Aki nem ért egyet, az a következő ülésen elmondhatja. A lista túl hosszú, és meg kell rövidíteni, mielőtt elküldjük a többieknek.",
    "tr": "Hatanın nedenini ancak akşam bulduk, çünkü hiç kimse bu kadar küçük bir şeyi düşünmemişti. Rapor artık her gece değil, yalnızca veriler değiştiği zaman hazırlanıyor. Bu konuda farklı düşünen bir kişi varsa bunu bir sonraki toplantıda söyleyebilir. Liste çok uzun ve ötekilere gönderilmeden önce kısaltılması gerekiyor.",
    "id": "Kami baru menemukan penyebab masalah itu pada malam hari, karena tidak ada yang memikirkan hal sekecil itu. Laporan tidak lagi dibuat setiap malam, tetapi hanya jika data berubah. Siapa yang tidak setuju dapat mengatakannya di rapat berikut. Daftar itu terlalu panjang dan harus dipotong sebelum dikirim ke yang lain.",
    "vi": "Chúng tôi chỉ tìm ra nguyên nhân của lỗi vào buổi tối, vì không ai nghĩ đến một điều nhỏ như vậy. Báo cáo không còn được tạo ra mỗi đêm nữa, mà chỉ khi dữ liệu thay đổi. Nếu ai không đồng ý thì có thể nói ra trong cuộc họp sau. Danh sách này quá dài và phải được rút ngắn trước khi gửi đi.",
    "ru": "Причину ошибки мы нашли только вечером, потому что никто не подумал о такой мелочи. Отчёт теперь создаётся не каждую ночь, а лишь тогда, когда меняются данные. Кто с этим не согласен, может сказать об этом на следующей встрече. Список слишком длинный, и его нужно сократить, прежде чем отправить его остальным.",
    "el": "Βρήκαμε την αιτία του λάθους μόλις το βράδυ, γιατί κανείς δεν είχε σκεφτεί κάτι τόσο μικρό. Η αναφορά δεν δημιουργείται πια κάθε νύχτα, αλλά μόνο όταν αλλάζουν τα δεδομένα. Όποιος δεν συμφωνεί μπορεί να το πει στην επόμενη συνάντηση. Η λίστα είναι πολύ μεγάλη και πρέπει να γίνει πιο μικρή πριν σταλεί.",
    "ar": "لم نجد سبب الخطأ إلا في المساء، لأن أحدا لم يفكر في شيء صغير مثل هذا. لا يكتب التقرير كل ليلة بعد الآن، بل عندما تتغير البيانات فقط. من لا يوافق على ذلك يمكنه أن يقول ذلك في الاجتماع القادم. القائمة طويلة جدا ويجب أن تختصر قبل أن ترسل إلى الآخرين.",
    "he": "מצאנו את סיבת התקלה רק בערב, כי איש לא חשב על דבר קטן כל כך. הדוח לא נוצר עוד בכל לילה, אלא רק כאשר הנתונים משתנים. מי שלא מסכים עם זה יכול לומר את זה בפגישה הבאה. הרשימה ארוכה מדי ויש לקצר אותה לפני שנשלח אותה אל האחרים.",
    "hi": "हमें गलती का कारण शाम को ही मिला, क्योंकि किसी ने इतनी छोटी बात के बारे में नहीं सोचा था। रिपोर्ट अब हर रात नहीं बनाई जाती है, बल्कि केवल तब जब आँकड़े बदलते हैं। जो इससे सहमत नहीं है, वह अगली बैठक में यह कह सकता है। सूची बहुत लंबी है और भेजने से पहले उसे छोटा करना होगा।",
    "ko": "우리는 저녁이 되어서야 오류의 원인을 찾았다. 아무도 그렇게 작은 일을 생각하지 못했기 때문이다. 보고서는 이제 매일 밤 만들어지지 않고, 자료가 바뀔 때에만 만들어진다. 이 일에 동의하지 않는 사람은 다음 회의에서 그렇게 말할 수 있다. 목록이 너무 길어서 보내기 전에 줄여야 한다.",
    "zh": "我们直到晚上才找到错误的原因，因为没有人想到这么小的事情。报告不再每天夜里生成，只有在数据发生变化的时候才会生成。如果有人不同意，可以在下一次会议上说出来。这个列表太长了，在发给其他人之前必须把它缩短。",
    "ja": "誰もそんな小さなことを考えていなかったので、夕方になってようやく間違いの原因が見つかりました。報告書はもう毎晩作られるのではなく、データが変わったときにだけ作られます。賛成できない人は、次の会議でそう言うことができます。一覧は長すぎるので、ほかの人に送る前に短くしなければなりません。",
}

#: Other structures made of words.
OTHER = {
    "list": "- lampada verde\n- copper kettle\n* Fenster\n* деревянный стол\n1. piedra\n2. ventana grande\n- κουρτίνα\n- papier\n",
    "lines": "lampada verde\ncopper kettle\nFenster\nдеревянный стол\npiedra\nventana grande\nκουρτίνα\npapier\nжелезная дорога\nсад\n",
    "signs": "苹果\n香蕉\n桌子\n窗户\n电话机\n铅笔\n雨伞\n自行车\n手表\nりんご\n机\n",
    "signs in a row": "苹果、香蕉、桌子、窗户、电话机、铅笔、雨伞、自行车、手表、りんご、机、椅子",
    "signs apart": "苹果 香蕉 桌子 窗户 电话机 铅笔 雨伞 自行车 手表 りんご 机 椅子",
    "commas": "apple, pera, lamp, Stein, rivière, kettle, ventana, jardín, copper, бумага, дверь, ручка, carpet, cuchara, окно",
    "words": "Copper lamp window river stone narrow kettle garden door; Paper carpet spoon wide handle bridge quiet table. Stone green river gate lamp early copper window garden",
    "more words": "lámpara Fenster carpeta kettle sombra bridge jardín silencio cuchara Fluss ventana, papier rivière Kupfer garden handle Brücke piedra mesa stone. carpet gate quiet window Tisch",
    "still more words": "табурет окно лампа дорога камень ручка, медный чайник занавеска бумага река. дверь мост ковёр ложка тихий стол сад зелёный",
    "navigation": "house > garden > gate\nriver > bridge | next\nhome | about | contact | previous\nlamp > switch > wire\n",
    "records": "lamp.size=green\nriver.open=true\nstone.name: null\nkettle.state -> closed\ncarpet.colour = red\n",
    "table": "| name | size | share |\n|---|---|---|\n| lamp | green | half |\n| stone | river | all |\n",
    "code": "def open_window(room, width=None):\n    if room.width > limit:\n        items.append(make_lamp(room))\n    return width\n",
    "keys": "asdf jkl; ghgh sdfkj;l qwpeoir sldkfj ;alskd ghfj\nlkjh; fdsa hjkl gfds ;lkj trewq poiuy asdfgh\n",
    "keys in lines": "qwoeirut dfj kl;sd fg\nzoiwert ;ldk fjg hsd ;fk aaj\ntruwoq hgfj dks;a lfj kkd gh;s\nreoiu fj dkls ;a ghf jdk\nwpoeirt skdj f;lg hh fjdk slla\n",
    "keys with stops": "asdf jkl. ghgh sdfkj l qwpeoir, sldkfj alskd ghfj. lkjh fdsa hjkl gfds, lkj trewq poiuy asdfgh. sdf kjh gfd",
}

_UNPARTED_SIGN = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿]")
#: Combining marks and vowel signs of Indic and Semitic scripts go on a word.
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-֑ͯ-ׇؐ-ًؚ-ٟऀ-ःऺ-ॏॢॣঀ-෿ั-๎’'](?=[^\W_]|[̀-๎\s.,;:!?।]|$))*")
_ASCII_WORD = re.compile(r"[A-Za-z]+(?:'(?![A-Za-z0-9_])(?=[\s.,;:!?]|$)|'[A-Za-z]+)*")
_AFTER = re.compile(r"[\"'”’»)\]」』]*([.!?…؟।。！？．]|[,;:،、，；：·])?[\"'”’»)\]」』]*(\n|\s|$)?")
_STOPS = frozenset(".!?…؟।。！？．")
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|�")
_MIXED = re.compile("[A-Za-zÀ-ɏ][Ͱ-෿က-ჿ぀-ￜ]|[Ͱ-෿][A-Za-zÀ-ɏ]")
_LENGTHS = np.array([0, 0, 1, 2, 3, 4, 4, 5, 5, 5, 6, 6, 6, 6, 7])  # class of a word by its letters
_WINDOW = 60
#: A line of so many words is wrapped text, and its end is like a blank.
_WRAPPED = 6


#: Words of three or more Latin consonants, which prose has few of.
_TOKEN = re.compile(r"[^\W\d_]{3,}")
_CONSONANTS = re.compile(r"[b-df-hj-np-tvwxz]+", re.I)


def _rows(block: str) -> np.ndarray:
    """The three distributions of a block in a row."""
    lengths, after, words = np.zeros(8), np.zeros(5), []
    last = line = 0  # `line`: words of the line so far
    for m in (_ASCII_WORD if block.isascii() else _WORD).finditer(block):
        w = m[0]
        lengths[_LENGTHS[min(len(w), 14)]] += 1
        a = _AFTER.match(block, m.end())
        mark, gap = a[1], a[2]
        line += 1
        if mark:
            after[2 if mark in _STOPS else 1] += 1
        elif gap is None:
            after[4] += 1  # a digit, sign or bracket
        else:
            after[3 if gap == "\n" and line < _WRAPPED else 0] += 1
        if gap == "\n":
            line = 0
        if m.start() > last and any(not c.isspace() and c not in "\"'“”‘’«»„(¿¡「『.,;:!?…—–-،、。，！？؟।" for c in block[last : m.start()]):
            after[4] += 1
        last = m.end()
        words.append(w.lower())
    repeated = np.zeros(4)
    for lo in range(0, len(words), _WINDOW):
        part = words[lo : lo + _WINDOW] if len(words) - lo > _WINDOW // 2 or not lo else words[max(0, len(words) - _WINDOW) :]
        seen: dict[str, int] = {}
        for w in part:
            seen[w] = seen.get(w, 0) + 1
        for w, n in seen.items():
            repeated[2 * (len(w) > 3) + (n < 2)] += n
    return np.concatenate([x / max(x.sum(), 1e-9) for x in (lengths, after, repeated)])


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    def h(x):
        return -np.where(x > 0, x * np.log2(np.maximum(x, 1e-300)), 0.0).sum(-1)

    return sum(np.maximum(0, h((p[a:b] + q[:, a:b]) / 2) - (h(p[a:b]) + h(q[:, a:b])) / 2) for a, b in ((0, 8), (8, 13), (13, 17)))


_PROFILES: tuple[np.ndarray, np.ndarray] | None = None


def reads_as_prose(block: str, least_letters: float = 0.8, most: float = 0.3, margin: float = 1.5) -> bool:
    """Whether a block is running prose of some language, as far as its rhythm tells: nearer by `margin` to a profile of prose than to any other, and near enough."""
    global _PROFILES
    if _PROFILES is None:
        _PROFILES = np.stack([_rows(x) for x in PROSE.values()]), np.stack([_rows(x) for x in OTHER.values()])
    visible = len(block) - sum(map(block.count, " \n\t\r"))
    if visible < 12:
        return False
    tokens = _TOKEN.findall(block)
    if 8 * len(list(filter(_CONSONANTS.fullmatch, tokens))) > len(tokens):
        return False  # beaten keys
    unparted = False
    if not block.isascii():
        letters = sum(map(str.isalpha, block))
        if 50 * len(_MOJIBAKE.findall(block)) > letters or 50 * len(_MIXED.findall(block)) > letters:
            return False
        unparted = len(_UNPARTED_SIGN.findall(block)) > letters / 2
    # lists need no profile: lines of a word or two, or a comma after each
    words = (_ASCII_WORD if block.isascii() else _WORD).findall(block)
    if not unparted and (len(words) < 2 * (block.count("\n") + 1) or 2 * block.count(",") > len(words)):
        return False
    if sum(map(len, words)) < least_letters * visible or len(words) < (3 if unparted else 8):
        return False
    row = _rows(block)
    prose, other = (_divergence(row, q).min() for q in _PROFILES)
    return bool(prose * margin < other and prose < most)
